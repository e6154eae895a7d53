"""Queries over what arrives: uploads in pieces, landing folders, and plates of several books."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.inputs import OCR_LINES, ocr_lines, table
from quire.plans.more import _bytes, _folder
from quire.operators import containers
from quire.sources import archives as A, files as S
from quire.streaming import landing as L, uploads as U

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: Bytes of a piece after the first three, and times at which pieces come.
PIECE, BATCHES = 4096, 2
_BEGINS = "CASE page_id % 8 WHEN 0 THEN '%PDX-' ELSE '%PDF-' END"
_WHOLE = f"CASE WHEN page_id % 8 = 4 THEN '%PD' ELSE {_BEGINS} || html END"


def upload_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(upload_id, start, data, total, arrived, batch): every page as an upload, in pieces of 1 to 7 bytes at first (so the signature is split) and
    of some thousand then, dealt over batches by a hash. By its number an upload has a wrong signature, declares too much, never ends, goes on
    beyond all bounds, or ends within the signature."""
    kind = F.col("page_id") % 8
    pages = table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), _bytes(F.expr(_WHOLE)).alias("content"))
    n, step = F.length("content"), (F.col("page_id") % 7 + 1).cast("int")
    starts = F.filter(F.concat(F.array(F.lit(0), step, 2 * step), F.expr(f"sequence(3 * cast(page_id % 7 + 1 as int), greatest(3 * cast(page_id % 7 + 1 as int), length(content)), {PIECE})")), lambda x: x < n)
    cut = pages.withColumn("starts", starts).select("page_id", "kind", "content", F.size("starts").alias("pieces"), F.posexplode("starts").alias("k", "start"), F.concat(F.slice("starts", 2, F.size("starts")), F.array(n)).alias("stops"))
    data = F.substring(F.col("content"), F.col("start") + 1, F.element_at("stops", F.col("k") + 1) - F.col("start"))
    declared = F.when(F.col("kind") == 1, F.lit(U.MOST + 1)).when(F.col("kind").isin(0, 4, 5, 6, 7), F.length("content"))
    found = cut.where((F.col("kind") != 2) | (F.col("k") < F.col("pieces") - 1)).select("page_id", F.col("start").cast("long").alias("start"), data.alias("data"), F.when(F.col("k") == F.col("pieces") - 1, declared).cast("long").alias("total"))
    beyond = pages.where("kind = 3").select("page_id", F.lit(U.MOST).cast("long").alias("start"), _bytes("x").alias("data"), F.lit(None).cast("long").alias("total"))
    # declared at once: the length that can't be taken
    first = pages.where("kind = 1").select("page_id", F.lit(0).cast("long").alias("start"), _bytes("%").alias("data"), F.lit(U.MOST + 1).cast("long").alias("total"))
    every = found.unionByName(beyond).unionByName(first).withColumn("batch", F.pmod(F.xxhash64("page_id", "start"), F.lit(BATCHES)).cast("int"))
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("batch"))
    return every.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("upload_id"), "start", "data", "total", arrived.alias("arrived"), "batch")


@query(f"""
WITH u AS (SELECT page_id, encode({_WHOLE}) AS content FROM pages)
SELECT 'p' || page_id AS upload_id, CASE WHEN page_id % 8 IN (0, 4) THEN 'not a PDF' WHEN page_id % 8 IN (1, 3) THEN 'too large' WHEN page_id % 8 = 2 THEN 'interrupted' ELSE 'accepted' END AS outcome,
  CASE WHEN page_id % 8 IN (5, 6, 7) THEN octet_length(content) END AS received, CASE WHEN page_id % 8 IN (5, 6, 7) THEN sha256(content) END AS content FROM u
""")
def chunked_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of uploads run through as a stream, which is stopped and begun anew between the batches; taken uploads are put together again."""
    chunks = upload_chunks(spark, sf_dir)
    # the last batch is a clock: much later, a byte of an upload that goes on
    clock = chunks.limit(0).unionByName(spark.range(1).select(F.lit("clock").alias("upload_id"), F.lit(0).cast("long").alias("start"), _bytes("%").alias("data"), F.lit(None).cast("long").alias("total"), F.timestamp_seconds(F.lit(1_700_010_000)).alias("arrived"), F.lit(BATCHES).alias("batch")))
    box, out, marks = (_folder(spark, x) for x in ("chunks-in", "chunks-out", "chunks-marks"))
    for k in range(BATCHES + 1):
        (chunks.where(F.col("batch") == k) if k < BATCHES else clock).drop("batch").write.mode("append").parquet(box)
        stream = spark.readStream.schema(chunks.drop("batch").schema).parquet(box)
        L.converted(U.outcomes(stream, patience=timedelta(minutes=30)), lambda rows: rows, out, marks).awaitTermination()
    told = spark.read.schema(U.OUTCOME).parquet(f"{out}/*")
    whole = U.assembled(spark.read.schema(chunks.drop("batch").schema).parquet(box), told.where("outcome = 'accepted'"))
    joined = told.join(whole.withColumnRenamed("upload_id", "whole_id"), F.col("upload_id") == F.col("whole_id"), "left")
    return joined.select("upload_id", "outcome", F.when(F.col("outcome") == "accepted", F.col("received")).alias("received"), F.sha2("content", 256).alias("content"))


_UPLOAD = "CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 5 = 0 THEN 'PDF' || s_nationkey ELSE '%PDF-' || s_nationkey END"


@query(f"""
WITH f AS (SELECT 's' || s_suppkey || '.pdf' AS name, {_UPLOAD} AS content, s_suppkey % 3 = 0 AS later FROM supplier),
r AS (SELECT *, CASE WHEN content = '' THEN 'empty' WHEN content NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'not a PDF' END AS refused FROM f)
SELECT name, length(content) AS length, CASE WHEN refused IS NULL THEN sha256(content) END AS upload_id,
  coalesce(refused, CASE WHEN row_number() OVER (PARTITION BY refused, content ORDER BY later, name) = 1 THEN 'accepted' ELSE 'repeated' END) AS outcome FROM r
""")
def upload_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing folder whose files have equal contents, are refused, or come late with times long past: each has one outcome."""
    box, out, marks = (_folder(spark, x) for x in ("ledger-in", "ledger-out", "ledger-marks"))
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("name"), _bytes(F.expr(_UPLOAD)).alias("content"))
    for later in (False, True, None):
        if later is not None:
            mine = files.where((F.col("s_suppkey") % 3 == 0) == F.lit(later))
            S.write_books(mine, box)
        if later:
            S.set_times(spark, box, mine.select("name"), 1_000_000_000)
        L.converted(L.ledger(L.arrivals(spark, box)), lambda rows: rows, out, marks).awaitTermination()
    told = spark.read.parquet(f"{out}/*").unionByName(L.empty_files(spark, box))
    return told.select("name", "length", "upload_id", "outcome")


@query(f"""
WITH {OCR_LINES}, p AS (SELECT book_id, page_no, page_no % 3 = 0 AS is_image, count(*) AS n FROM lines GROUP BY book_id, page_no),
i AS (SELECT book_id, page_no FROM p WHERE (length(book_id) + page_no) % 2 = 0)
SELECT book_id, page_no AS "pageIndex", CASE WHEN i.page_no IS NOT NULL THEN 'images/page_' || (p.page_no + 1) || '.png' END AS "imagePath" FROM p LEFT JOIN i USING (book_id, page_no)
""")
def plates_of_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose plates have equal names, each with every other one of them, and which ones by the book."""
    pages = ocr_lines(spark, sf_dir).groupBy("book_id", "page_no").agg(F.count("*").alias("n"))
    name = F.format_string("page_%d.png", F.col("page_no") + 1)
    images = pages.where((F.length("book_id") + F.col("page_no")) % 2 == 0).select("book_id", name.alias("name"))
    kind = F.when(F.col("page_no") % 3 == 0, "image").otherwise("text")
    path = F.when(F.col("page_no") % 3 > 0, F.concat(F.lit("out/"), name))
    return S.with_plates(pages.select("book_id", F.col("page_no").alias("pageIndex"), kind.alias("type"), path.alias("imagePath")), images).select("book_id", "pageIndex", "imagePath")


@query("SELECT 'a' || doc_id // 100 AS archive, 'd' || doc_id || '.txt' AS member, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS digest, NULL::VARCHAR AS error FROM documents UNION ALL SELECT 'a' || doc_id // 100, 'mimetype', 4, md5('text'), NULL FROM documents GROUP BY 1")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts packed into archives of a hundred, written all or none, and read again member by member."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), F.floor(F.col("doc_id") / 100).cast("string")).alias("book_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), _bytes(F.coalesce("text", F.lit(""))).alias("content"))
    first = docs.select("book_id").distinct().select("book_id", F.lit("mimetype").alias("path"), _bytes("text").alias("content"))
    shelf = _folder(spark, "shelf")
    S.write_books(containers.packed(docs.unionByName(first)).select(F.concat("book_id", F.lit(".epub")).alias("name"), "content"), shelf)
    return A.members(spark, shelf).select("archive", "member", "size", F.md5("content").alias("digest"), "error")
