"""Queries over pictures of books, names by locale, metrics of running jobs and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import books as B, containers as C, images as I, lateral, pages as P
from quire.plans import assembly as A
from quire.plans.inputs import table
from quire.plans.more import _folder
from quire.plans.trees import _N, _VISIBLE, _markdown
from quire.sources import files as S
from quire.sources.progress import watched

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pictures a nation, of which every fifth nation lacks the second; and one nobody asks for."""
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("book_id"), "n_nationkey", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    return own.where((F.col("n_nationkey") % 5 > 0) | (F.col("k") != 1)).select("book_id", F.format_string("p%d.png", "k").alias("name"), F.unhex(F.lit("89504E470D0A1A0A")).alias("content"))


_SHELF = "s AS (SELECT n_nationkey::VARCHAR AS book_id, n_nationkey, list_sort(list_distinct(list('p' || s_suppkey % 3 || '.png'))) AS wanted FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"


@query(f"WITH {_SHELF} SELECT book_id, CASE WHEN sound THEN wanted END AS pictures, sound FROM (SELECT *, n_nationkey % 5 > 0 OR NOT list_contains(wanted, 'p1.png') AS sound FROM s)")
def plated_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web books of pages with pictures: a book carries those its pages ask for, in order, and one that lacks any isn't given out."""
    pages = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("book_id"), F.concat(F.lit("ch"), F.col("s_suppkey").cast("string"), F.lit(".html")).alias("name"), F.concat(F.lit("<h1>"), X.escape_text(F.col("s_name")), F.lit('</h1><p><img src="../images/p'), (F.col("s_suppkey") % 3).cast("string"), F.lit('.png" alt="x"></p>')).alias("html"))
    books = pages.select("book_id").distinct().select("book_id", F.concat(F.lit("Book "), "book_id").alias("title"), F.lit("en").alias("language"))
    job = A.sites(pages, books, _pictures(spark, sf_dir), P.Options(rewrites={"../images/": "images/"}))
    package = C.unpacked(job.archives).where(F.col("path").endswith(".opf")).select("book_id", F.regexp_extract_all(X.decoded_bytes(F.col("content")), F.lit('href="images/([^"]+)"'), F.lit(1)).alias("pictures"))
    return books.select("book_id").join(package, "book_id", "left").select("book_id", "pictures", F.col("pictures").isNotNull().alias("sound"))


@query(f"WITH {_SHELF} SELECT book_id, 'p1.png' AS missing FROM s WHERE n_nationkey % 5 = 0 AND list_contains(wanted, 'p1.png')")
def markdown_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown books that embed pictures: the report of those that no file has."""
    embeds = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("book_id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("![[p"), (F.col("s_suppkey") % 3).cast("string"), F.lit(".png]]")))), "\n\n").alias("body"))
    books = embeds.select("book_id", F.concat(F.lit("---\ntitle: B\nlang: en\n---\n\n# One\n\n"), "body", F.lit("\n")).alias("source"))
    return A.markdown(books, _pictures(spark, sf_dir)).report.select("book_id", F.col("name").alias("missing"))


#: Names with one number, in the order of the locale: letters first, then accents, then width and case.
BY_LOCALE = ["ch7 a.html", "ｃh7 a.html", "Ch7 a.html", "çh7 a.html", "Çh7 a.html", "ch7 b.html", "ch7 Z.html", "éh7.html", "zh7.html"]
_LISTED = "[" + ", ".join(f"'{n}'" for n in BY_LOCALE) + "]"


@query(f"SELECT s_suppkey, name, (10 * k + place)::BIGINT AS place FROM (SELECT s_suppkey, unnest({_LISTED}) AS name, generate_subscripts({_LISTED}, 1) AS place, 0 AS k FROM supplier UNION ALL SELECT s_suppkey, 'ch12.html', 1, 1 FROM supplier)")
def chapters_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of chapters of one number, in the order of the locale rather than of bytes; larger numbers come after."""
    names = F.array(*(F.lit(n) for n in [*reversed(BY_LOCALE), "ch12.html"]))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(names).alias("name"))
    return B.in_order(rows, "s_suppkey", "name").select("s_suppkey", "name", F.col("place").cast("long").alias("place"))


@query(rf"SELECT count(*) AS pages, 0::BIGINT AS failed, sum({_N(_VISIBLE, r'(?i)<li[\s>]')})::BIGINT AS items, sum({_N(_VISIBLE, r'(?i)<a\s[^>]*href=')})::BIGINT AS links FROM pages")
def observed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning all pages says of itself, taken while its rows were written."""
    done = P.sanitised(table(spark, sf_dir, "pages"))
    _, told = watched(done, "watched", pages=F.count(F.lit(1)), failed=F.count("error"), items=F.sum(F.col("arrived")[2]).cast("long"), links=F.sum(F.col("arrived")[1]).cast("long"))
    return spark.createDataFrame([(told["pages"], told["failed"], told["items"], told["links"])], "pages long, failed long, items long, links long")


@query("SELECT doc_id::VARCHAR AS book_id, kind, n FROM documents, (VALUES ('paragraph', 4::BIGINT), ('quote', 1), ('heading', 1), ('list', 2), ('image', 1), ('fence', 1)) v(kind, n) WHERE text IS NOT NULL")
def lateral_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as markdown books, read by a table function within SQL."""
    lateral.register(spark)
    return spark.sql("SELECT book_id, b.kind, count(*) AS n FROM {books}, LATERAL markdown_blocks(source) b GROUP BY book_id, b.kind", books=_markdown(spark, sf_dir))


#: Pictures are 20 + key % 23 wide and 10 + key % 41 high, and are to be 32 at most.
_WIDE, _HIGH, _LONGEST = "20 + s_suppkey % 23", "10 + s_suppkey % 41", 32
_SIDE = lambda side: f"greatest(round(({side}) * least(1.0::DOUBLE, {_LONGEST}::DOUBLE / greatest({_WIDE}, {_HIGH}))), 1)::INT"


@query(f"SELECT 's' || s_suppkey || '.png' AS name, s_suppkey % 5 > 0 AS shrunk, CASE WHEN s_suppkey % 5 > 0 THEN {_SIDE(_WIDE)} WHEN s_suppkey % 10 = 5 THEN ({_WIDE})::INT END AS width, CASE WHEN s_suppkey % 5 > 0 THEN {_SIDE(_HIGH)} WHEN s_suppkey % 10 = 5 THEN ({_HIGH})::INT END AS height FROM supplier")
def pictures_made_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of every supplier, scaled and given palettes; what is cut short or no picture keeps its bytes."""
    import numpy as np
    import pyarrow as pa

    def drawn(batches):
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                w, h = 20 + key % 23, 10 + key % 41
                x, y = np.meshgrid(np.arange(w), np.arange(h))
                pixels = np.stack([x // 4 * 20 + key, y // 4 * 24, x // 8 * 9], -1).astype(np.uint8)
                content = I.png(w, h, 2, 8, pixels.reshape(h, -1), level=0)
                rows.append((f"s{key}.png", b"no picture" if key % 10 == 0 else content[:60] if key % 5 == 0 else content))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], ["name", "content"])

    folder = _folder(spark, "pictures")
    S.write_books(table(spark, sf_dir, "supplier").select("s_suppkey").mapInArrow(drawn, "name string, content binary"), folder)
    made = I.smaller(spark, folder, _LONGEST)
    return S.image_sizes(made).select("name", F.col("new_size").isNotNull().alias("shrunk"), "width", "height")
