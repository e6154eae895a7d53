"""Archives of any size and state are read member by member, and files are written all or none."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import archives as A


def archive(path, members, **options):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, **options) as z:
        for name, content in members:
            z.writestr(name, content)


def read(spark, folder, **limits):
    return {(r.archive, r.member): (r.content and bytes(r.content), r.error) for r in A.members(spark, str(folder), **limits).collect()}


def test_members_in_any_state(spark, tmp_path):
    archive(tmp_path / "a.epub", [("mimetype", b"x"), ("d/", b""), ("d/é.txt", "ü".encode() * 1000)])
    archive(tmp_path / "bomb.epub", [("zeros", bytes(20 << 20)), ("fine", b"1")])
    archive(tmp_path / "none.epub", [])
    (tmp_path / "junk.epub").write_bytes(b"no archive at all")
    (tmp_path / "other.txt").write_bytes(b"not looked at")
    whole = (tmp_path / "a.epub").read_bytes()
    (tmp_path / "short.epub").write_bytes(whole[: len(whole) // 2])
    broken = bytearray(whole)
    broken[broken.index(b"d/\xc3\xa9.txt") + 14] ^= 0xFF
    (tmp_path / "broken.epub").write_bytes(bytes(broken))
    locked = bytearray(whole)
    for sign, at in ((b"PK\3\4", 6), (b"PK\1\2", 8)):
        locked[locked.index(sign) + at] |= 1
    (tmp_path / "locked.epub").write_bytes(bytes(locked))
    got = read(spark, tmp_path, ratio=500)
    assert got["a", "mimetype"] == (b"x", None) and got["a", "d/é.txt"] == ("ü".encode() * 1000, None) and ("a", "d/") not in got
    assert got["bomb", "zeros"] == (None, "packed too often over") and got["bomb", "fine"] == (b"1", None)
    assert got["junk", None][1].startswith("not a readable archive") and got["short", None][1].startswith("not a readable archive")
    assert got["broken", "mimetype"] == (b"x", None) and got["broken", "d/é.txt"][1].startswith("broken")
    assert got["locked", "mimetype"] == (None, "encrypted") and not any(a in ("none", "other") for a, _ in got)
    assert read(spark, tmp_path, ratio=500, most=1999)["a", "d/é.txt"] == (None, "too large")
    assert read(spark, tmp_path, ratio=500, split=64) == got


def test_large_tables_and_far_members(spark, tmp_path):
    archive(tmp_path / "many.epub", [(f"m{k}", b"%d" % k) for k in range(66_000)])
    far = tmp_path / "far.epub"
    with open(far, "wb") as f:
        f.truncate(5 << 30)  # sparse: members begin beyond four gigabytes
    with zipfile.ZipFile(far, "a") as z:
        z.writestr("one", b"1" * 1000)
        z.writestr("two", b"2")
    rows = A.members(spark, str(tmp_path), split=1 << 17)
    assert rows.rdd.getNumPartitions() > 2
    assert rows.where("archive = 'many'").select(F.count("*"), F.sum("size"), F.count_if(F.col("member") == F.concat(F.lit("m"), F.col("content").cast("string"))), F.count("error")).collect()[0] == (66_000, sum(len(str(k)) for k in range(66_000)), 66_000, 0)
    assert {(r.member, r.ordinal, len(r.content)) for r in rows.where("archive = 'far'").collect()} == {("one", 0, 1000), ("two", 1, 1)}


def files(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir()}


def test_files_all_or_none(spark, tmp_path):
    schema = "name string, content binary"
    A.write_files(spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", None)], schema).repartition(3), str(tmp_path))
    assert files(tmp_path) == {"a": b"1", "b": b"2", "c": b""}
    A.write_files(spark.createDataFrame([("b", b"3"), ("d", b"4")], schema), str(tmp_path))
    before = {"a": b"1", "b": b"3", "c": b"", "d": b"4"}
    assert files(tmp_path) == before
    many = [(f"n{k}", b"x") for k in range(40)]
    for bad in (("../out", b"5"), ("x/y", b"5"), (None, b"5"), ("", b"5"), ("..", b"5"), ("n1", b"5")):
        with pytest.raises(Exception):
            A.write_files(spark.createDataFrame([("a", b"9"), *many, bad], schema).repartition(4), str(tmp_path))
        assert files(tmp_path) == before and not (tmp_path.parent / "out").exists()


def test_a_move_that_fails_takes_all_back(tmp_path):
    w = A.FileWriter({"path": str(tmp_path)})
    (tmp_path / "a").write_bytes(b"old")
    import pyarrow as pa

    batch = lambda *names: pa.RecordBatch.from_arrays([pa.array(names), pa.array([n.encode() for n in names])], ["name", "content"])
    first, again, second = w.write(iter([batch("a", "b")])), w.write(iter([batch("a", "b")])), w.write(iter([batch("c")]))
    os.remove(f"{second.folder}/c")  # what a lost machine leaves
    with pytest.raises(OSError):
        w.commit([first, second])
    assert files(tmp_path) == {"a": b"old"}
    w = A.FileWriter({"path": str(tmp_path)})
    first, again = w.write(iter([batch("a", "b")])), w.write(iter([batch("a", "b")]))
    w.commit([again, None])  # an attempt that ran twice counts once
    assert files(tmp_path) == {"a": b"a", "b": b"b"} and first.folder != again.folder
    w.abort([])


def test_tasks_that_fail_leave_nothing(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") < 19, F.lit(b"x")).otherwise(F.raise_error(F.lit("lost")).cast("binary")).alias("content")).repartition(4)
    with pytest.raises(Exception, match="lost"):
        A.write_files(rows, str(tmp_path / "new"))
    assert not (tmp_path / "new").exists() or not list((tmp_path / "new").iterdir())


def test_archives_out_and_in(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x", b"y")
    A.write_files(spark.createDataFrame([("q.epub", buffer.getvalue())], "name string, content binary"), str(tmp_path))
    assert read(spark, tmp_path) == {("q", "x"): (b"y", None)}
