"""Tables of the engine's own shapes, derived from the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt over all cores: a table's few small files would else be as few tasks for what Python makes of each row."""
    return rows.repartition(4 * max(4, rows.sparkSession.sparkContext.defaultParallelism), key)


LINES_A_PAGE = 30
#: Documents of a source whose numbers share all but so much are a book: books don't grow with the data.
A_BOOK = 100


def ocr_book(doc_id: str = "doc_id") -> Column:
    """The book that a document is laid out in."""
    return F.concat("source", F.lit("-"), F.floor(F.col(doc_id) / A_BOOK).cast("string")).alias("book_id")


def ocr_lines(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Documents as books, some of a source each, their lines laid out on pages of thirty by rule. More columns are worked out before lines meet, so a plan that needs no texts moves none."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select(ocr_book(), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    n = F.length("text")
    i = F.col("pos") % LINES_A_PAGE
    at = lines.withColumn("page", F.floor(F.col("pos") / LINES_A_PAGE)).withColumns({
        "line_no": i,
        "x": F.when(n % 4 == 0, 160).otherwise(100) / 1000.0,
        "y": (970 - 31 * i - F.when(n % 3 == 0, 11).otherwise(0)) / 1000.0,
        "height": F.when(n % 7 == 0, 40).when(n % 5 == 0, 24).otherwise(20) / 1000.0,
        "width": F.lit(0.7),
    })
    at = at.select("*", *more)
    page_no = F.dense_rank().over(Window.partitionBy("book_id").orderBy("doc_id", "page")) - 1
    return at.withColumn("page_no", page_no).select("book_id", "page_no", "line_no", "text", "x", "y", "width", "height", *at.columns[len(at.columns) - len(more):])


OCR_LINES = f"""
raw AS (SELECT source || '-' || doc_id // {A_BOOK} AS book_id, doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT book_id, (dense_rank() OVER (PARTITION BY book_id ORDER BY doc_id, pos // {LINES_A_PAGE}) - 1)::INT AS page_no, (pos % {LINES_A_PAGE})::INT AS line_no, text,
  (CASE WHEN length(text) % 4 = 0 THEN 160 ELSE 100 END)::DOUBLE / 1000 AS x, (970 - 31 * (pos % {LINES_A_PAGE}) - CASE WHEN length(text) % 3 = 0 THEN 11 ELSE 0 END)::DOUBLE / 1000 AS y,
  (CASE WHEN length(text) % 7 = 0 THEN 40 WHEN length(text) % 5 = 0 THEN 24 ELSE 20 END)::DOUBLE / 1000 AS height FROM raw)
"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, doc_path, ord, raw): hrefs of the pages, a book per hundred pages."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "raw")
    return table(spark, sf_dir, "pages").select((F.floor(F.col("page_id") / 100)).cast("long").alias("book_id"), F.concat(F.lit("text/"), F.col("page_id").cast("string"), F.lit(".html")).alias("doc_path"), found)


PAGE_LINKS = """
links AS (SELECT page_id // 100 AS book_id, 'text/' || page_id || '.html' AS doc_path, generate_subscripts(h, 1) - 1 AS ord, unnest(h) AS raw FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))
"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, page_id, title): the first heading of each page, its references decoded."""
    from quire.functions.text import trim, unescape_basic

    title = trim(unescape_basic(F.regexp_replace(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")))
    return table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).cast("long").alias("book_id"), "page_id", title.alias("title"))


_TITLE = r"regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"
for _ref, _raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_ref}', '{_raw}')"
SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PAGE_TITLES = f"titles AS (SELECT page_id // 100 AS book_id, page_id, regexp_replace({_TITLE}, '^{SPACE}+|{SPACE}+$', '', 'g') AS title FROM pages)"
