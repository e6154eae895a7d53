import json

from pyspark.sql import functions as F

from quire.operators import containers, ocr
from quire.sources import files as S
from quire.streaming import landing as L


def test_ocr_json_and_plates(spark, tmp_path):
    pages = [{"pageIndex": 0, "type": "image", "imagePath": None, "lines": []}, {"pageIndex": 1, "type": "text", "lines": [{"text": "x", "x": 0.1, "y": 0.5, "width": 0.1, "height": 0.02}]}]
    (tmp_path / "book.json").write_text(json.dumps(pages), encoding="utf-8")
    df = S.ocr_books(spark, str(tmp_path))
    assert {(r.book_id, r.pageIndex, r.type) for r in df.collect()} == {("book", 0, "image"), ("book", 1, "text")}
    assert ocr.exploded(df).collect()[0].text == "x"
    images = spark.createDataFrame([("book", "page_1.jpeg")], "book_id string, name string")
    assert {r.pageIndex: r.imagePath for r in S.with_plates(df, images).collect()} == {0: "images/page_1.jpeg", 1: None}


def test_image_heads(spark):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    df = spark.createDataFrame([("a.png", png), ("b.jpg", b"\xff\xd8\xff\xe0"), ("c", b"")], "name string, content binary")
    assert {r.name: (r.format, r.width, r.height) for r in S.image_sizes(df).collect()} == {"a.png": ("png", 640, 480), "b.jpg": ("jpeg", None, None), "c": (None, None, None)}


def test_landing_stream(spark, tmp_path):
    box, out = tmp_path / "in", tmp_path / "out"
    box.mkdir()
    (box / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (box / "b.pdf").write_bytes(b"hello")
    stream = L.arrivals(spark, str(box))
    L.converted(stream, L.accepted, str(out), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.name for r in spark.read.parquet(str(out)).collect()] == ["a.pdf"]
    (box / "c.pdf").write_bytes(b"%PDF-1.4 y")
    L.converted(L.arrivals(spark, str(box)), L.accepted, str(out), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.name for r in spark.read.parquet(str(out)).collect()) == ["a.pdf", "c.pdf"]
    batch = spark.read.format("binaryFile").load(str(box))
    assert {r.refused for r in L.checked(batch, 9).collect()} == {"too large", "not a PDF"}


def test_folder_books_and_writer(spark, tmp_path):
    (tmp_path / "lib" / "b1" / "OEBPS").mkdir(parents=True)
    (tmp_path / "lib" / "b1" / "mimetype").write_text("application/epub+zip")
    (tmp_path / "lib" / "b1" / "OEBPS" / "x.css").write_text("p{}")
    df = containers.folder_files(spark, str(tmp_path / "lib"))
    assert {(r.book_id, r.path) for r in df.collect()} == {("b1", "mimetype"), ("b1", "OEBPS/x.css")}
    S.write_books(containers.packed(df).select(F.concat("book_id", F.lit(".epub")).alias("name"), "content"), str(tmp_path / "shelf"))
    assert containers.unpacked(containers.archives(spark, str(tmp_path / "shelf"))).count() == 2
    assert S.listing(spark, str(tmp_path / "lib")).count() == 2


def test_small_tables(spark, tmp_path):
    from quire.sources import tables as Tb

    (tmp_path / "map.json").write_text('{"fw-box": "box", "x": "y"}', encoding="utf-8")
    assert {tuple(r) for r in Tb.class_map(spark, str(tmp_path / "map.json")).collect()} == {("fw-box", "box"), ("x", "y")}
    (tmp_path / "names.json").write_text('{"annotations": {"annotations": {"🚀": {"tts": ["rocket"]}}}}', encoding="utf-8")
    names = Tb.pictograph_names(spark, str(tmp_path / "names.json"))
    glyphs = spark.createDataFrame([("🚀",), ("👁️",)], "glyph string")
    assert {tuple(r) for r in Tb.named(glyphs, names).collect()} == {("🚀", "rocket"), ("👁️", "U+1F441")}
    import hashlib

    files = spark.createDataFrame([("/a/x", b"1"), ("/a/y", b"2")], "path string, content binary")
    pins = spark.createDataFrame([("x", hashlib.sha256(b"1").hexdigest()), ("y", "00"), ("z", "00")], "name string, sha256 string")
    assert {tuple(r) for r in Tb.wrong_checksums(files, pins).collect()} == {("y", "another checksum"), ("z", "missing")}
    refs = spark.createDataFrame([("../images/a",), ("../x",), ("q",)], "r string")
    assert [r.x for r in refs.select(Tb.rewritten_prefix(F.col("r"), {"../": "up/", "../images/": "images/"}).alias("x")).collect()] == ["images/a", "up/x", "q"]


def test_ink(spark):
    import numpy as np

    from quire.operators import images as I

    page = np.full((40, 60, 3), 255, np.uint8)
    page[10:30, 20:40] = 0
    blank = np.full((4, 4, 1), 250, np.uint8)
    df = spark.createDataFrame([("cover", 60, 40, 3, bytearray(page.tobytes())), ("blank", 4, 4, 1, bytearray(blank.tobytes()))], "name string, width int, height int, channels int, data binary")
    got = {r.name: r for r in I.ink(df).collect()}
    assert (got["cover"].left, got["cover"].top, got["cover"].right, got["cover"].bottom) == (20, 10, 39, 29) and abs(got["cover"].ink - 400 / 2400) < 1e-9
    assert got["blank"].left is None and got["blank"].ink == 0
    assert {(r.name, r.error) for r in I.shelf_verdicts(I.ink(df)).collect()} == {("blank", "too little contrast"), ("blank", "too little ink")}
    sizes = spark.createDataFrame([("a", 3200, 1600), ("b", 10, 20)], "name string, width int, height int")
    assert [(r.new_width, r.new_height) for r in I.resize_plan(sizes).orderBy("name").collect()] == [(1600, 800), (10, 20)]


def test_intermediate_tables_can_go(spark):
    import os

    from quire.sources.session import clear, own_dir, written

    kept = written(spark.range(5).toDF("x"), "t")
    assert kept.count() == 5
    folder = own_dir(spark).removeprefix("file:")
    assert os.path.isdir(folder)
    clear(spark)
    assert not os.path.isdir(folder)


def test_batches_go_through_python_in_small_parts():
    import pyarrow as pa

    from quire.sources.session import SLICE_ROWS, slices

    large = pa.record_batch([pa.array(range(50)), pa.array(["x" * 1_000_000] * 50)], ["k", "t"])
    many = pa.record_batch([pa.array(range(10_000)), pa.array([""] * 10_000)], ["k", "t"])
    parts = list(slices([large, many, many.slice(0, 0)]))
    assert [k for p in parts for k in p.column(0).to_pylist()] == [*range(50), *range(10_000)]
    assert all(p.num_rows <= 4 for p in parts[:13]) and max(p.num_rows for p in parts) <= SLICE_ROWS
