"""Names by locale, closures, table functions and metrics of running jobs."""

import io
import zipfile

from pyspark.sql import functions as F

from quire.operators import bookmd, books as B, containers as C, lateral
from quire.sources.progress import listening, watched
from quire.streaming import landing as L


def test_names_by_locale(spark):
    names = ["b2", "B10", "a2", "Ä2", "z2", "A2", "ä2", "none", "a02", "é2", "a12345678901234567890123456789"]
    df = spark.createDataFrame([("x", n) for n in names], "book string, name string")
    got = {r.name: r.place for r in B.in_order(df, "book", "name").collect()}
    assert got.pop("none") is None
    assert sorted(got, key=got.get) == ["a02", "a2", "A2", "ä2", "Ä2", "b2", "é2", "z2", "B10", "a12345678901234567890123456789"]
    swedish = {r.name: r.place for r in B.in_order(df, "book", "name", "sv").collect()}
    assert swedish["ä2"] > swedish["z2"] > swedish["é2"]


def closure(edges):
    known = set(edges)
    while True:
        more = {(a, d) for a, b in known for c, d in edges if b == c} - known
        if not more:
            return known
        known |= more


def test_closures(spark):
    chain = [(k, k + 1) for k in range(70)]
    for edges in (chain, [(k, (k + 1) % 9) for k in range(9)], [(0, k) for k in range(1, 40)] + [(k, 100) for k in range(1, 40)] + [(100, 0)], [(1, 1)], []):
        found = B.reachable(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()
        assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == closure(edges)
    assert B.reachable(spark.createDataFrame([(1, None), (None, 2), (2, 3)], "a long, b long")).count() == 1


def test_table_functions_give_the_rows_of_the_operators(spark):
    lateral.register(spark)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b", b"x")
        z.writestr("d/", b"")
        z.writestr("c", b"")
    archives = spark.createDataFrame([("one", out.getvalue()), ("bad", b"zz"), ("null", None)], "book_id string, content binary")
    mine = spark.sql("SELECT book_id, f.path, f.ord, f.content, f.error FROM {a}, LATERAL archive_files(content) f", a=archives.withColumnRenamed("path", "x"))
    assert B.differences(mine, C.unpacked(archives).select("book_id", "path", "ord", "content", "error")).count() == 0 and mine.count() == 4
    books = spark.createDataFrame([("m", "# A\n\n> q\n> - r\n\n```\nx\n```\n![[p.png|y]]\n"), ("n", None)], "book_id string, source string")
    rows = spark.sql("SELECT book_id, b.* FROM {m}, LATERAL markdown_blocks(source) b", m=books)
    assert B.differences(rows, bookmd.blocks(bookmd.parsed(books))).count() == 0 and rows.count() == 5


def test_metrics_are_those_of_a_second_pass(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    table, told = watched(df, "watched", n=F.count(F.lit(1)), most=F.max("k"), odd=F.count_if(F.col("id") % 2 == 1))
    assert told == table.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("most"), F.count_if(F.col("id") % 2 == 1).alias("odd")).collect()[0].asDict()


def test_streams_tell_of_their_batches(spark, tmp_path):
    told = listening(spark)
    try:
        for n in (3, 4):
            spark.range(n).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").observe("rows", F.count(F.lit(1)).alias("n"))
            L.converted(stream, lambda rows: rows, f"{tmp_path}/out", f"{tmp_path}/marks").awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        import time

        for _ in range(40):
            if len(told.rows) >= 2:
                break
            time.sleep(0.25)
    finally:
        spark.streams.removeListener(told)
    assert [(name, values["n"]) for name, _, values in told.rows] == [("rows", 3), ("rows", 4)]
