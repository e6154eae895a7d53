"""Uploads in pieces and files of a landing folder: each has one outcome, whatever the order, the time or a failure."""

import hashlib
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.sources import files as S
from quire.streaming import landing as L, uploads as U

CHUNK = "upload_id string, start long, data binary, total long, arrived timestamp"
BEGAN = datetime(2024, 5, 1)


def run(spark, folder, most=100):
    stream = spark.readStream.schema(CHUNK).parquet(f"{folder}/in")
    L.converted(U.outcomes(stream, most, timedelta(minutes=5)), lambda rows: rows, f"{folder}/out", f"{folder}/marks").awaitTermination(120)
    return {r.upload_id: r.outcome for r in spark.read.schema(U.OUTCOME).parquet(f"{folder}/out/*").collect()}


def test_runs_grow_together():
    rng = random.Random(1)
    for _ in range(200):
        runs = [(a, a + rng.randint(0, 5)) for a in (rng.randint(0, 30) for _ in range(8))]
        want = {x for a, b in runs for x in range(a, b)}
        got = U.merged(runs)
        assert {x for a, b in got for x in range(a, b)} == want and all(b < c for (_, b), (c, _) in zip(got, got[1:]))


@pytest.mark.parametrize(("head", "runs", "total", "over", "want"), [
    (b"%PDF-", [(0, 9)], 9, False, "accepted"), (b"%PDF-", [(0, 9)], None, False, None), (b"%PDF-", [(0, 9)], None, True, "interrupted"), (b"%PD\0\0", [(0, 3)], 3, False, "not a PDF"),
    (b"%PDX\0", [(0, 4)], None, False, "not a PDF"), (b"%PDF-", [(0, 5), (7, 101)], None, False, "too large"), (b"\0" * 5, [(7, 101)], None, False, None), (b"\0" * 5, [(7, 101)], None, True, "too large"),
    (b"\0" * 5, [], 101, False, "too large"), (b"\0" * 5, [], 0, False, "not a PDF"), (b"\0" * 5, [], None, True, "interrupted"), (b"\0" * 5, [(-3, 2)], 4, False, "not a PDF"), (b"%PDF-", [(0, 100)], 100, False, "accepted"),
])
def test_verdicts(head, runs, total, over, want):
    assert U.verdict(head, runs, total, 100, over) == want


def test_pieces_in_any_order_over_restarts(spark, tmp_path):
    rng = random.Random(7)
    contents = {f"u{k}": b"%PDF-" + bytes(rng.randrange(256) for _ in range(rng.randint(0, 60))) for k in range(12)}
    rows = []
    for name, content in contents.items():
        at = 0
        while at < len(content):
            end = min(len(content), at + rng.randint(1, 7))
            rows.append((name, at, content[at:end], len(content) if end == len(content) else None))
            at = end
    rows += [("wrong", 0, b"%P", None), ("wrong", 2, b"XX", None), ("open", 0, b"%PDF-1", None), ("far", 99, b"xx", None), ("far", 0, b"%PDF-", None), ("void", 0, None, 0)]
    rows += rng.sample(rows, 10)  # some come twice
    rng.shuffle(rows)
    at = lambda minutes: BEGAN + timedelta(minutes=minutes)
    for k in range(3):
        spark.createDataFrame([(*r, at(k)) for r in rows[k::3]], CHUNK).write.mode("append").parquet(f"{tmp_path}/in")
        got = run(spark, tmp_path)
    assert got == {**dict.fromkeys(contents, "accepted"), "wrong": "not a PDF", "far": "too large", "void": "not a PDF"}
    spark.createDataFrame([("clock", 0, b"", None, at(60))], CHUNK).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(spark, tmp_path)
    assert got.pop("open") == "interrupted" and len(got) == 15
    told = spark.read.schema(U.OUTCOME).parquet(f"{tmp_path}/out/*")
    assert told.count() == 16
    whole = U.assembled(spark.read.schema(CHUNK).parquet(f"{tmp_path}/in"), told.where("outcome = 'accepted'"))
    assert {r.upload_id: bytes(r.content) for r in whole.collect()} == contents


def test_late_equal_refused_and_replayed(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()

    def put(name, content, age=0):
        (box / name).write_bytes(content)
        when = datetime.now().timestamp() - age
        os.utime(box / name, (when, when))

    def go(convert=lambda rows: rows):
        return L.converted(L.ledger(L.arrivals(spark, str(box))), convert, str(tmp_path / "out"), str(tmp_path / "marks"))

    put("a.pdf", b"%PDF-a")
    put("bad.pdf", b"hello")
    put("none.pdf", b"")
    go().awaitTermination(120)
    put("new.pdf", b"%PDF-new")
    put("old.pdf", b"%PDF-old", 7_200)
    put("ancient.pdf", b"%PDF-ancient", 30 * 86_400)
    put("again.pdf", b"%PDF-a", 90_000)

    def broken(rows):
        rows.collect()
        raise RuntimeError("the batch fails after its work")

    with pytest.raises(Exception, match="fails after its work"):
        go(broken).awaitTermination(120)
    go().awaitTermination(120)  # the batch comes again, with the same rows
    go().awaitTermination(120)
    told = spark.read.parquet(str(tmp_path / "out/*")).unionByName(L.empty_files(spark, str(box)))
    got = sorted((r.name, r.outcome, (r.holder or "").rsplit("/", 1)[-1]) for r in told.collect())
    assert got == [("a.pdf", "accepted", "a.pdf"), ("again.pdf", "repeated", "a.pdf"), ("ancient.pdf", "accepted", "ancient.pdf"), ("bad.pdf", "not a PDF", ""), ("new.pdf", "accepted", "new.pdf"), ("none.pdf", "empty", ""), ("old.pdf", "accepted", "old.pdf")]
    assert {r.upload_id for r in told.where("name = 'old.pdf'").collect()} == {hashlib.sha256(b"%PDF-old").hexdigest()}


def test_a_claim_ends_after_its_time(spark, tmp_path):
    import time

    schema = "k string, who string"
    spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = L.converted(U.once(stream, "k", ["who"], "who", timedelta(seconds=1)), lambda rows: rows, f"{tmp_path}/out", f"{tmp_path}/marks", once_through=False)

    def told(n):
        """The rows so far, once there are n: such a stream goes on making batches."""
        for _ in range(120):
            rows = spark.read.schema("k string, who string, first boolean, holder string").parquet(f"{tmp_path}/out/*").collect() if os.path.isdir(f"{tmp_path}/out") else []
            if len(rows) >= n:
                break
            time.sleep(0.5)
        return sorted((r.k, r.who, r.first) for r in rows)

    try:
        assert told(3) == [("x", "a", True), ("x", "b", False), ("y", "c", True)]
        time.sleep(2)
        spark.createDataFrame([("x", "d")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert told(4) == [("x", "a", True), ("x", "b", False), ("x", "d", True), ("y", "c", True)]
    finally:
        query.stop()


def test_plates_stay_in_their_books(spark):
    pages = spark.createDataFrame([(b, k, t, p) for b in ("a", "b", "c") for k, t, p in ((0, "image", None), (1, "text", "out/page_2.png"), (2, "text", None))], "book_id string, pageIndex int, type string, imagePath string")
    images = spark.createDataFrame([("a", "page_1.png"), ("a", "page_2.png"), ("a", "page_3.png"), ("b", "page_2.png"), ("b", "page_99999999999999.png"), (None, "page_1.png")], "book_id string, name string")
    got = {(r.book_id, r.pageIndex): r.imagePath for r in S.with_plates(pages, images).collect()}
    assert got == {("a", 0): "images/page_1.png", ("a", 1): "images/page_2.png", ("a", 2): None, ("b", 0): None, ("b", 1): "images/page_2.png", ("b", 2): None, ("c", 0): None, ("c", 1): None, ("c", 2): None}
    with pytest.raises(ValueError):
        S.with_plates(pages, images.drop("book_id"))
    assert S.with_plates(pages.withColumn("own", F.lit(1)), images).columns == [*pages.columns, "own"]


def test_refused_files_leave_no_state_each(spark, tmp_path):
    # before, each refused file had a key, and so a state, of its own
    from quire.streaming import landing as L

    box = tmp_path / "box"
    box.mkdir()
    for k in range(80):
        (box / f"r{k:02}.pdf").write_bytes(b"no PDF %d" % (k % 3))
    for k in range(4):
        (box / f"a{k}.pdf").write_bytes(b"%%PDF-%d" % (k // 2))
    out = f"{tmp_path}/out"
    query = L.converted(L.ledger(L.arrivals(spark, str(box))), lambda rows: rows, out, f"{tmp_path}/marks")
    query.awaitTermination()
    told = {r.name: (r.outcome, r.holder, r.upload_id is None) for r in spark.read.parquet(f"{out}/*").collect()}
    assert len(told) == 84 and all(told[f"r{k:02}.pdf"] == ("not a PDF", None, True) for k in range(80))
    assert [told[f"a{k}.pdf"][0] for k in range(4)] == ["accepted", "repeated"] * 2
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= L.REFUSED_KEYS + 2
