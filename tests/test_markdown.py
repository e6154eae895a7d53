"""Both readings of markdown give the same blocks, and faults show on their side."""

import random

from pyspark.sql import functions as F

from quire.operators import bookmd, books as B, markdown as R

LINES = ["", "", " ", "text here", "more *text* [a](b)", "# One", "## Two ", "####### no", "#no", "> quoted", ">", ">> deep", "> > deeper", "> # inside", "> * a", ">```", "> ~~~", "* a", "* b", "- c", "+ d", "*no", "```", "````", "``` info", "~~~", "~~~~ x", "``` ` ", "![[a.png]]", "![[a.png|alt|b]]", "![alt](c.png)", "![](c.png)", "![x", "　> wide", "\t# tab", "\xa0", "---", "a: b", "~~", "> ![[q.png|r]]", "text\r", "a b", "> - x", "* ", "# "]


def sources(n, seed):
    rng = random.Random(seed)
    heads = ["", "---\ntitle: T\nlang: en\nmood: x:y\n---\n", "---\ntitle: T\n", " --- \n---\n", "---\ntitle: a\ntitle: b\n: c\nnone\n---"]
    return [(f"b{k}", rng.choice(heads) + rng.choice(("\n", "\r\n")).join(rng.choice(LINES) for _ in range(rng.randint(0, 25)))) for k in range(n)]


def test_readings_agree(spark):
    rows = [*sources(600, 5), ("null", None), ("empty", ""), ("fences", "```\n" * 301), ("quotes", ">" * 12 + "x\n" + "> " * 8 + "y")]
    df = spark.createDataFrame(rows, "book_id string, source string").repartition(6)
    chapters, blocks = R.read(df)
    found = bookmd.parsed(df)
    assert B.differences(blocks, bookmd.blocks(found).select(*R.BLOCK_COLUMNS)).take(5) == []
    assert B.differences(chapters, bookmd.chapters(found).select(*chapters.columns)).take(5) == []
    assert B.differences(R.metadata(df), found.select("book_id", "metadata")).take(5) == []
    kinds = {r.kind for r in blocks.select("kind").distinct().collect()}
    assert kinds == {"paragraph", "heading", "quote", "list", "image", "fence"} and blocks.where("parent_id is not null").count() > 100


def test_faults_show_on_their_side(spark):
    df = spark.createDataFrame([("a", "# T\n\none\n\ntwo"), ("b", "x")], "book_id string, source string")
    other = df.withColumn("source", F.replace("source", F.lit("two"), F.lit("three")))
    rows = B.differences(R.read(df)[1], bookmd.blocks(bookmd.parsed(other)).select(*R.BLOCK_COLUMNS)).collect()
    assert {(r.side, r.text) for r in rows} == {("left", "two"), ("right", "three")}
    by_book = R.disagreements(df, bookmd.parsed(other)).select(*R.BLOCK_COLUMNS, "side")
    assert sorted(map(repr, (tuple(r[c] for c in (*R.BLOCK_COLUMNS, "side")) for r in rows))) == sorted(map(repr, map(tuple, by_book.collect())))
    assert R.read(df.limit(0))[1].count() == 0


def test_data_columns_read_books_once_and_stay_in_their_row(spark):
    sources = [("b", "---\ntitle: t\n---\n\n# One\n\ntext [l](x.html)\n\n> ### In\n> quoted\n\n* a\n* b\n\n![[p.png|A]]\n\n## Two\n"), ("none", "")]
    found = bookmd.data_columns(bookmd.parsed(spark.createDataFrame(sources, "book_id string, source string")))
    # before: three readings of every book and four exchanges
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    rows = {r.book_id: r for r in found.collect()}
    assert rows["b"].texts == ["text [l](x.html)", "In", "quoted", "a", "b"] and rows["b"].links == ["x.html"] and [tuple(i) for i in rows["b"].images] == [("p.png", "A")]
    assert rows["none"].texts == [] and rows["none"].images is None
