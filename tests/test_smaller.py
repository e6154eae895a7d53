"""Pictures made smaller: sizes, colours, and what keeps its bytes."""

import numpy as np

from quire.operators import images as I


def written(folder, pictures, level=0):
    for name, pixels in pictures.items():
        h, w, c = pixels.shape
        (folder / name).write_bytes(I.png(w, h, {1: 0, 3: 2, 4: 6}[c], 8, pixels.reshape(h, -1), level=level))


def read_again(spark, folder, rows):
    out = folder / "again"
    out.mkdir()
    for r in rows:
        (out / r.name).write_bytes(bytes(r.content))
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}
    return {r.name: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[..., order[r.channels]] for r in I.decoded(spark, str(out)).collect()}


def test_pictures_become_smaller(spark, tmp_path):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:200, :300]
    smooth = np.stack([x * 255 // 299, y * 255 // 199, (x + y) % 256], -1).astype(np.uint8)
    few = rng.integers(0, 3, (50, 61, 1)).astype(np.uint8) * np.array([[[100, 20, 7]]], np.uint8)
    clear = np.dstack([smooth[:90, :80], np.where(x[:90, :80] < 40, 0, 255).astype(np.uint8)])
    grey = rng.integers(0, 256, (40, 40, 1)).astype(np.uint8)
    pictures = {"smooth.png": smooth, "few.png": few, "clear.png": clear, "grey.png": grey, "one.png": np.full((1, 1, 3), 9, np.uint8)}
    written(tmp_path, pictures)
    (tmp_path / "cut.png").write_bytes((tmp_path / "few.png").read_bytes()[:99])
    (tmp_path / "junk.png").write_bytes(b"junk")
    (tmp_path / "photo.jpg").write_bytes(b"\xff\xd8\xff\xe0 not really")
    rows = I.smaller(spark, str(tmp_path), 150).collect()
    got = {r.name: r for r in rows}
    assert len(got) == 8
    for name in ("cut.png", "junk.png", "photo.jpg"):
        assert got[name].new_size is None and bytes(got[name].content) == (tmp_path / name).read_bytes()
    for r in rows:
        assert r.new_size is None or r.new_size == len(r.content) < r.original_size
        assert len(r.content) <= r.original_size
    again = read_again(spark, tmp_path, [got[n] for n in pictures])
    assert again["smooth.png"].shape == (100, 150, 3) and got["smooth.png"].new_size
    small = I.scaled(smooth, 150, 100)
    assert np.abs(again["smooth.png"].astype(int) - small).mean() < 8 and np.abs(again["smooth.png"].astype(int) - small).max() < 90
    assert (again["few.png"] == few).all() and got["few.png"].new_size < 61 * 50 / 2
    assert (again["clear.png"][:, :40, 3] == 0).all() and (again["clear.png"][:, 41:, 3] == 255).all()
    assert np.abs(again["grey.png"][..., :1].astype(int) - grey).max() <= 8


def test_scaling_keeps_means():
    rng = np.random.default_rng(5)
    pixels = rng.integers(0, 256, (31, 47, 3)).astype(np.uint8)
    out = I.scaled(pixels, 13, 7)
    assert out.shape == (7, 13, 3) and np.abs(out.mean((0, 1)) - pixels.mean((0, 1))).max() < 1
    assert (I.scaled(pixels, 47, 31) == pixels).all() and (I.scaled(np.full((9, 9, 1), 77, np.uint8), 2, 4) == 77).all()
    even = np.arange(16, dtype=np.uint8).reshape(4, 4, 1)
    assert (I.scaled(even, 2, 2)[..., 0] == np.rint([[2.5, 4.5], [10.5, 12.5]])).all()


def test_palettes_fall_where_colours_are():
    rng = np.random.default_rng(6)
    colours = np.unique(rng.integers(0, 32, (3000, 3)), axis=0)
    box = I.palette_of(colours, np.ones(len(colours)), 64)
    assert len(np.unique(box)) == 64
    assert (I.palette_of(np.array([[1, 1, 1]]), np.array([5]), 64) == 0).all()
    assert len(np.unique(I.palette_of(colours[:10], np.ones(10), 256))) == 10
