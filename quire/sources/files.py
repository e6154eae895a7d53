"""Readers and writers of the shapes the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import decoded_bytes
from quire.functions.names import basename, is_image
from quire.operators.ocr import PAGES_SCHEMA
from quire.sources.archives import write_files


def ocr_books(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, PAGES_SCHEMA): scanned books, one JSON array of pages a file."""
    text = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    schema = f"array<struct<{PAGES_SCHEMA}>>"
    pages = F.inline(F.from_json(decoded_bytes(F.col("content")), schema))
    return text.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("book_id"), pages)


def site(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Chapters (name, html) and images (name, content) of a site's folder."""
    read = lambda sub: spark.read.format("binaryFile").load(f"{folder}/{sub}")
    chapters = read("chapters").where(F.lower("path").rlike(r"\.html?$")).select(basename(F.col("path")).alias("name"), decoded_bytes(F.col("content")).alias("html"))
    images = read("images").where(is_image(F.col("path"))).select(basename(F.col("path")).alias("name"), "content")
    return chapters, images


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def image_sizes(images: DataFrame) -> DataFrame:
    """images(name, content) with format, width and height from their bytes; null where they don't say."""
    head = lambda a, n: F.hex(F.substring("content", a, n))
    number = lambda c: F.conv(c, 16, 10).cast("int")
    little = lambda a: number(F.concat(head(a + 1, 1), head(a, 1)))
    kind = F.when(head(1, 8) == "89504E470D0A1A0A", "png").when(head(1, 3) == "FFD8FF", "jpeg").when(head(1, 4) == "47494638", "gif").when(F.lower(decoded_bytes(F.substring("content", 1, 200))).contains("<svg"), "svg")
    # a JPEG's sizes are in its frame, behind segments whose lengths lead from one to the next
    at = lambda a, n: F.conv(F.hex(F.substring(F.col("content"), a, F.lit(n))), 16, 10).cast("int")

    def segment(acc: Column, _: Column) -> Column:
        mark = at(acc["at"] + 1, 1)
        frame = mark.between(0xC0, 0xCF) & ~mark.isin(0xC4, 0xC8, 0xCC)
        inside = (at(acc["at"], 1) == 0xFF) & (acc["at"] < F.length("content"))
        step = F.when(mark == 0xFF, 1).otherwise(at(acc["at"] + 2, 2) + 2)
        done = acc["height"].isNotNull() | ~F.coalesce(inside, F.lit(False))
        moved = F.struct(F.when(frame, acc["at"]).otherwise(F.coalesce(acc["at"] + step, F.length("content"))).alias("at"), F.when(frame, at(acc["at"] + 5, 2)).alias("height"), F.when(frame, at(acc["at"] + 7, 2)).alias("width"))
        return F.when(done, acc).otherwise(moved)

    none = F.lit(None).cast("int")
    jpeg = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.lit(3).alias("at"), none.alias("height"), none.alias("width")), segment)
    tag = F.regexp_extract(decoded_bytes(F.substring("content", 1, 4000)), r"(?is)<svg\b[^>]*>", 0)
    drawn = lambda name: F.nullif(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([0-9]+)(?:\.[0-9]+)?(?:px)?["']""", 1), F.lit("")).cast("int")
    size = lambda name, png, gif: F.when(kind == "png", number(head(png, 4))).when(kind == "gif", little(gif)).when(kind == "jpeg", jpeg[name]).when(kind == "svg", drawn(name))
    return images.withColumn("format", kind).withColumn("width", size("width", 17, 7)).withColumn("height", size("height", 21, 9))


def with_plates(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages(book_id, pageIndex, imagePath, …) whose image path is that of a file of images(book_id, name) of the same book, by name or by page number."""
    if "book_id" not in images.columns:
        raise ValueError("images need the book_id they belong to: plates of different books have the same names")
    files = images.select(F.col("book_id").alias("of_book"), F.col("name").alias("own")).where("of_book is not null").distinct()
    numbered = files.select(F.col("of_book").alias("in_book"), F.regexp_extract("own", r"page_(\d+)\.", 1).try_cast("int").alias("number"), F.col("own").alias("by_number")).where("number is not null").groupBy("in_book", "number").agg(F.min("by_number").alias("by_number"))
    rows = pages.select(F.struct(*pages.columns).alias("page"))
    joined = rows.join(files, (F.col("page.book_id") == F.col("of_book")) & (F.substring_index("page.imagePath", "/", -1) == F.col("own")), "left")
    joined = joined.join(numbered, (F.col("page.book_id") == F.col("in_book")) & (F.col("number") == F.col("page.pageIndex") + 1), "left")
    named = F.coalesce("own", F.when(F.col("page.imagePath").isNull() & (F.col("page.type") == "image"), F.col("by_number")))
    return joined.select(*(F.concat(F.lit("images/"), named).alias(c) if c == "imagePath" else F.col(f"page.`{c}`").alias(c) for c in pages.columns))


def write_books(books: DataFrame, folder: str) -> None:
    """One file per row of books(name, content), all or none of them: see `archives.write_files`.

    The folder may be of any file system that Arrow reaches (a path, file:, hdfs:, s3:, gs:); on a cluster it is one that all machines see."""
    write_files(books, folder)


def set_times(spark: SparkSession, folder: str, names: DataFrame, seconds: int) -> None:
    """Sets the modification time of files of a folder, as a copy that keeps times does."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in names.toLocalIterator():
        files.setTimes(hadoop.Path(root, r[0]), 1000 * seconds, -1)


__all__ = ["image_sizes", "listing", "ocr_books", "site", "with_plates", "set_times", "write_books"]
