"""Queries that read the whole of their inputs, on small inputs of their own and at a small scale."""

import hashlib

from quire.plans import registry

DIR = "/root/testdata/sf0.01"


def run(spark, name, at=DIR):
    return registry.queries()[name](spark, str(at)).collect()


def test_markdown_of_all_lines(spark, tmp_path):
    """Chapters, blocks and texts counted line by line; the template has two chapters and eight blocks."""
    own = ["first", "second\nthird\n\nfourth\n* a\n* b\n> quoted\n# Last [z](z.html)\nend", "", "x\n" * 40 + "\n- late"]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(own)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r.book_id): r for r in run(spark, "bookmd_whole_columns", tmp_path)}
    assert [(got[k].chapters, got[k].blocks) for k in range(4)] == [(2, 9), (3, 14), (2, 8), (2, 10)]
    texts = [["first"], ["second third", "fourth", "a", "b", "quoted", "end"], [], [" ".join("x" * 40), "late"]]
    for k, t in enumerate(texts):
        assert got[k].digest == hashlib.md5("\n".join(["Before.", "Inside", "quoted", "one", "two", "three", *t]).encode()).hexdigest()
        assert got[k].is_fixpoint and got[k].links == ["y.html", *(["z.html"] if k == 1 else [])]


def test_markdown_of_real_documents(spark):
    """Lines of these documents have no marks and no blank lines between them: each document is one paragraph."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {int(r.book_id): r for r in run(spark, "bookmd_whole_columns")}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        want = ["Before.", "Inside", "quoted", "one", "two", "three", " ".join(x.strip(" \t　\xa0") for x in text.split("\n"))]
        assert (got[k].chapters, got[k].blocks, got[k].digest) == (2, 9, hashlib.md5("\n".join(want).encode()).hexdigest())


def test_pictographs_after_the_first_characters(spark, tmp_path):
    text = "a" * 200 + " 🚀 end\n" + "b" * 200 + "🧠"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = run(spark, "strip_pictographs_whole", tmp_path)[0]
    want = "a" * 200 + " end " + "b" * 200 + "a" * 200 + " end\n" + "b" * 200
    assert (got.n, got.digest) == (1 + 2 + 2 + 1 + 2 + 1, hashlib.md5(want.encode()).hexdigest())


def test_title_lines_of_whole_titles(spark):
    parts = {f"part-{r.p_partkey}": r.p_name for r in spark.read.parquet(f"{DIR}/part.parquet").collect()}
    pages = {f"page-{r.page_id}": r.title for r in run(spark, "page_headings")}
    found = {}
    for r in sorted(run(spark, "title_lines_whole")):
        found.setdefault(r.title_id, []).append(r.line)
    titles = {k: " ".join(v.split()) for k, v in (parts | pages).items() if v and v.strip()}
    assert {k: " ".join(v) for k, v in found.items()} == titles


def test_pages_without_a_number_are_errors(spark, tmp_path):
    urls = ["http://a/c10.html", "http://a/about.html", "http://a/c9.html", "http://b/x", "http://b/2"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.place, r.error) for r in run(spark, "chapter_places", tmp_path)}
    assert got == {0: (2, None), 1: (None, "no number"), 2: (1, None), 3: (None, "no number"), 4: (1, None)}


def test_guards_and_gaps_over_whole_tables(spark, tmp_path):
    """Keys that the filters of chapters_required and coverage_gaps leave out; 2, 8 and 9 lack their other side."""
    put = lambda name, rows, columns: spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("nation", [(1,), (2,), (3,)], "n_nationkey int")
    put("customer", [(5, 1), (6, 3), (7, 3), (8, 1)], "c_custkey long, c_nationkey int")
    put("orders", [(1, 5), (2, 6), (3, 7), (4, 9)], "o_orderkey long, o_custkey long")
    assert [(r.book_id, r.error) for r in run(spark, "chapters_required_whole", tmp_path)] == [(2, "no chapters")]
    assert sorted((r.k, r.in_left, r.in_right) for r in run(spark, "coverage_gaps_whole", tmp_path)) == [(8, False, True), (9, True, False)]
