"""Queries that read trees: pages, markdown and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import bookmd, containers, pages as P, repair
from quire.plans.inputs import table
from quire.sources.session import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_VISIBLE = r"regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script\b.*?</script\s*>', '', 'gis'), '<style\b.*?</style\s*>', '', 'gis')"
_BODY = rf"regexp_replace(regexp_replace({_VISIBLE}, '<nav\b.*?</nav\s*>', '', 'gis'), '<footer\b.*?</footer\s*>', '', 'gis')"
_N = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_CENSUS = f"c AS (SELECT page_id, {_N(_VISIBLE, r'(?i)<a\s[^>]*href=')} AS links, {_N(_BODY, r'(?i)<a\s[^>]*href=')} AS links_kept, {_N(_VISIBLE, r'(?i)<li[\s>]')} AS list_items, {_N(_BODY, r'(?i)<li[\s>]')} AS list_items_kept, {_N(_VISIBLE, r'(?i)<h[1-6][\s>]')} AS headings, {_N(_BODY, r'(?i)<h[1-6][\s>]')} AS headings_kept FROM pages)"
#: A map of classes of the queries' own: those of sites, and what a book calls them.
CLASS_MAP = {"hero": "lead", "note": "aside", "promo-box": "panel", "caption-text": "caption"}
_OPTIONS = P.Options(language="en", css="style.css", fallback_title="Untitled", class_map=CLASS_MAP)


@query(f"WITH {_CENSUS} SELECT * FROM c")
def page_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.quick_census(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", n.alias("n")).select("page_id", *(F.col(f"n.{c}").cast("long").alias(c) for c in ("links", "links_kept", "list_items", "list_items_kept", "headings", "headings_kept")))


@query(f"WITH {_CENSUS} SELECT page_id, category, total, total AS chrome FROM (SELECT page_id, 'links' AS category, links - links_kept AS total FROM c UNION ALL SELECT page_id, 'listItems', list_items - list_items_kept FROM c UNION ALL SELECT page_id, 'headings', headings - headings_kept FROM c) WHERE total > 0")
def drop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = P.drop_report(P.sanitised(table(spark, sf_dir, "pages"), _OPTIONS))
    return lost.select("page_id", "category", F.col("total").cast("long").alias("total"), F.col("chrome").cast("long").alias("chrome"))


@query()
def sanitised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sanitised(table(spark, sf_dir, "pages"), _OPTIONS).select("page_id", "title", "xhtml", "error")


# pages whose article stands in a cell of a table in a quotation, behind a picture and text that is loose in the table
_IN_TABLE = ("<article>", '<article><blockquote><img src="a.png"><table>loose <a href="l">link</a><tr><td>cell <b>')
_OUT_OF_TABLE = ("</article>", "</table></blockquote></article>")
_TABLED = f"replace(replace(html, '{_IN_TABLE[0]}', '{_IN_TABLE[1]}'), '{_OUT_OF_TABLE[0]}', '{_OUT_OF_TABLE[1]}')"
_CLASSES = {"images": r"<img\s", "links": r"<a\s[^>]*href=", "listItems": r"<li[\s>]", "headings": r"<h[1-6][\s>]", "tables": r"<table[\s>]", "blockquotes": r"<blockquote[\s>]"}
_COUNTED = " UNION ALL ".join(f"SELECT page_id, '{k}' AS category, {_N(_VISIBLE, '(?i)' + p)} AS arrived, {_N(_BODY, '(?i)' + p)} AS survived FROM p" for k, p in _CLASSES.items())


@query(f"WITH p AS (SELECT page_id, {_TABLED} AS html FROM pages) SELECT page_id, category, arrived, arrived - survived AS chrome, survived FROM ({_COUNTED})")
def page_census_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's tree holds of all six classes, before and after its chrome is gone, and within that."""
    counted = P.sanitised(table(spark, sf_dir, "pages").select("page_id", F.expr(_TABLED).alias("html")), _OPTIONS)
    at = lambda c: F.element_at(c, F.col("k") + 1).cast("long").alias(c)
    names = F.array(*map(F.lit, P.CENSUS))
    return counted.select("page_id", F.posexplode("arrived").alias("k", "n"), "arrived", "chrome", "survived").select("page_id", F.element_at(names, F.col("k") + 1).alias("category"), at("arrived"), at("chrome"), at("survived"))


_T = "('d' || coalesce(doc_id, 0) || ' ' || coalesce(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ''))"
#: Markup around a text T, and what the standard makes of it (loose runs in a division of their own).
MISNESTED = [
    ("<table>T<tr><td>x</table>", "<div>T</div><table><tbody><tr><td>x</td></tr></tbody></table>"),
    ("<b><p>T</b>y</p>", "<div><b></b></div><p><b>T</b>y</p>"),
    ('<a href="u">x<blockquote>T<a href="v">z', '<div><a href="u">x</a></div><blockquote><a href="u">T</a><a href="v">z</a></blockquote>'),
    ("<p>T<textarea><b></textarea><p>y", "<p>T<textarea>&lt;b&gt;</textarea></p><p>y</p>"),
    ("<form><p>T<form><p>y</form>z", "<form><p>T</p><p>y</p></form><div>z</div>"),
    ("<button>T<button>y", "<div><button>T</button><button>y</button></div>"),
    ("<ul><li>T<li><i><p>x</i>y</ul>z", "<ul><li>T</li><li><i></i><p><i>x</i>y</p></li></ul><div>z</div>"),
    ("<table><td><p>T<table><td>x</table></table>y", "<table><tbody><tr><td><p>T</p><table><tbody><tr><td>x</td></tr></tbody></table></td></tr></tbody></table><div>y</div>"),
]
_MADE = lambda side: f"CASE coalesce(doc_id, 0) % {len(MISNESTED)} " + " ".join(f"WHEN {k} THEN replace('{m[side]}', 'T', {_T})" for k, m in enumerate(MISNESTED)) + " END"


@query(f"SELECT doc_id, {_MADE(1)} AS body FROM documents")
def misnested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in markup that is misnested, unclosed or misplaced, as sound pages."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.expr(f"'<!doctype html>' || {_MADE(0)}").alias("html"))
    sound = P.sanitised(docs, P.Options(strip=False))
    return sound.select(F.col("page_id").alias("doc_id"), F.regexp_extract("xhtml", r"(?s)<body>(.*)</body>", 1).alias("body"))


@query("SELECT p_partkey, nullif(array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'lead' END, CASE WHEN p_size % 3 = 0 THEN 'aside' END, CASE WHEN p_size % 5 = 0 THEN 'panel' END], lambda x: x IS NOT NULL), ' '), '') AS classes FROM part")
def class_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda n, c: F.when(F.col("p_size") % n == 0, c)
    raw = F.concat_ws(" ", F.lit("fade-up"), on(2, "hero"), on(2, " lead"), on(3, "note"), F.lit(" accent"), on(5, "panel"), on(5, "promo-box"))
    return table(spark, sf_dir, "part").select("p_partkey", P.translated_classes(raw, CLASS_MAP).alias("classes"))


@query("SELECT r_regionkey, r_name AS book_class FROM region WHERE r_name NOT IN (SELECT 'ASIA' UNION ALL SELECT 'EUROPE')")
def class_map_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = spark.range(1).select(F.lit(".ASIA { color: red } p.EUROPE, .x-1 { margin: 0 }").alias("css"))
    return P.undefined_targets(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("book_class")), sheet).select("r_regionkey", "book_class")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown books: a heading, quoted and listed lines, a picture and a fence."""
    run = F.concat(F.lit("x "), F.translate("text", "\n\r[", "   "))  # one paragraph of the whole text, without links
    docs = table(spark, sf_dir, "documents").where("text is not null")
    source = F.concat(F.lit("---\ntitle: "), F.col("source"), F.lit("\nlang: "), F.col("lang"), F.lit("\ndirection: ltr\nmood: calm\n---\n\nBefore.\n\n# Chapter [x](y.html)\n\n"), run, F.lit("\n> # Inside\n> quoted\n\n* one\n* two\n- three\n\n![[plate.png|A plate]]\n\n```\n# no heading\n```\n\n## Second\n\n"), run, F.lit("\n"))
    return docs.select(F.col("doc_id").cast("string").alias("book_id"), source.alias("source"))


@query("SELECT doc_id::VARCHAR AS book_id, 2::BIGINT AS chapters, 10::BIGINT AS blocks, true AS is_fixpoint, ['y.html'] AS links FROM documents WHERE text IS NOT NULL")
def bookmd_data_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bookmd.parsed(_markdown(spark, sf_dir))
    kept = bookmd.data_columns(found).select("book_id", "links")
    return found.select("book_id", F.size("chapters").cast("long").alias("chapters"), F.size("blocks").cast("long").alias("blocks"), "is_fixpoint").join(kept, "book_id")


def _whole_head() -> F.Column:
    """Front matter and blocks of every kind, before a document's own lines."""
    return F.concat(F.lit("---\ntitle: "), F.coalesce("source", F.lit("")), F.lit("\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\ndirection: ltr\nmood: calm\n---\n\nBefore.\n\n# Chapter [x](y.html)\n\n> # Inside\n> quoted\n\n* one\n* two\n- three\n\n![[plate.png|A plate]]\n\n```\n# no heading\n```\n\n## Second\n\n"))


@query()
def bookmd_whole_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown books of all lines of every document, as they are, after blocks of every kind."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    found = bookmd.parsed(docs.select(F.col("doc_id").cast("string").alias("book_id"), F.concat(_whole_head(), "text", F.lit("\n")).alias("source")))
    kept = bookmd.data_columns(found).select("book_id", F.md5(F.array_join("texts", "\n")).alias("digest"), "links")
    return found.select("book_id", F.size("chapters").cast("long").alias("chapters"), F.size("blocks").cast("long").alias("blocks"), "is_fixpoint").join(kept, "book_id")


@query("SELECT doc_id::VARCHAR AS book_id, 'right' AS side, 'paragraph' AS kind, 'planted ' || doc_id AS text FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0")
def parsers_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, as markdown read by both readers, of which the second gets a paragraph more in every seventh book: nothing else differs."""
    from quire.operators import markdown

    docs = table(spark, sf_dir, "documents").where("text is not null")
    own = docs.select(F.col("doc_id").cast("string").alias("book_id"), F.concat(_whole_head(), "text", F.lit("\n")).alias("source"), "doc_id")
    other = own.withColumn("source", F.when(F.col("doc_id") % 7 == 0, F.concat("source", F.lit("\n\nplanted "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise(F.col("source")))
    return markdown.disagreements(own, bookmd.parsed(other)).select("book_id", "side", "kind", "text")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as packed books of their customers: every fifth lacks a file, every seventh has one too many."""
    from quire.functions.text import escape_text
    from quire.plans import documents as D
    from quire.plans.queries import _shelf

    books, chapters, _ = _shelf(spark, sf_dir)
    books = books.join(chapters.select("book_id").distinct(), "book_id", "left_semi").withColumn("cover", F.lit(""))
    opf = D.package_documents(books, chapters, spark.createDataFrame([], "book_id int, ord int, name string"))
    tables = D.contents_documents(books, chapters)
    bytes_ = lambda c: F.encode(c, "UTF-8")
    row = lambda df, path, content: df.select("book_id", path.alias("path"), bytes_(content).alias("content"))
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    page = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title></head><body><p>'), escape_text(F.col("title")), F.lit('</p><a href="1.xhtml#a">first</a></body></html>'))
    files = row(books, F.lit("mimetype"), F.lit("application/epub+zip")).unionByName(row(books, F.lit("META-INF/container.xml"), F.lit(container))).unionByName(row(opf, F.lit("OEBPS/content.opf"), F.col("opf"))).unionByName(row(books, F.lit("OEBPS/style.css"), F.lit("p { margin: 0 }")))
    files = files.unionByName(row(tables, F.lit("OEBPS/toc.ncx"), F.col("ncx"))).unionByName(row(tables.join(books.where("version = '3.0'"), "book_id", "left_semi"), F.lit("OEBPS/nav.xhtml"), F.col("nav")))
    files = files.unionByName(row(chapters.where("not (book_id % 5 = 0 and chapter_no = 2)"), F.concat(F.lit("OEBPS/"), "href"), page)).unionByName(row(books.where("book_id % 7 = 0"), F.lit("OEBPS/extra.txt"), F.lit("x")))
    return containers.packed(files)


@query("WITH n AS (SELECT c_nationkey AS b, count(*) AS n FROM customer GROUP BY ALL) SELECT b::VARCHAR AS book_id, NOT (b % 5 = 0 AND n > 1 OR b % 7 = 0) AS success, CASE WHEN b % 5 = 0 AND n > 1 AND b % 2 = 1 THEN '2.xhtml has no file' WHEN b % 5 = 0 AND n > 1 THEN 'OEBPS/2.xhtml does not exist' WHEN b % 7 = 0 THEN 'Orphan file: OEBPS/extra.txt' END AS error FROM n")
def packed_book_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.verdicts(written(_books(spark, sf_dir), "books"))


@query("SELECT c_nationkey::VARCHAR AS book_id, 'The <Book> of ' || n_name AS title, CASE WHEN n_nationkey % 2 = 1 THEN '3.0' ELSE '2.0' END AS version, count(*) AS chapters, count(*) AS labelled FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def packed_book_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = written(containers.documents(containers.unpacked(_books(spark, sf_dir))), "documents")
    v = containers.volumes(read)
    n = v["chapters"].groupBy("book_id").agg(F.count("*").alias("chapters"), F.count_if(F.col("label") != "").alias("labelled"))
    return v["volume"].select("book_id", "title", "version").join(n, "book_id")


@query("SELECT p_partkey::VARCHAR AS book_id, 'p { ' || CASE WHEN p_size % 2 = 0 THEN '' ELSE 'background: url(images/' || p_size || '.png); ' END || 'color: red; }' AS css, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS dropped FROM part")
def healed_stylesheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    css = F.concat(F.lit("p { background: url("), F.when(F.col("p_size") % 2 == 0, "http://x.example/a.png").otherwise(F.concat(F.lit("images/"), F.col("p_size").cast("string"), F.lit(".png"))), F.lit("); color: red; }"))
    sheets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.lit("style.css").alias("path"), css.alias("css"))
    done = repair.healed_stylesheets(sheets)
    return done.select("book_id", F.regexp_replace("css", r"^p \{\s*", "p { ").alias("css"), F.size("dropped").alias("dropped"))
