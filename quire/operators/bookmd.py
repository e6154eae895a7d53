"""Markdown books as tables of books, chapters and blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import decoded_bytes
from quire.functions import bookmd as M
from quire.sources.session import importable

BLOCK = "struct<chapter_no:int,block_id:int,parent_id:int,ord:int,kind:string,level:int,text:string,marker:string,items:array<string>,href:string,alt:string,form:string,info:string>"
META = "struct<title:string,lang:string,direction:string,author:string,translator:string,cover:string,extras:array<struct<key:string,value:string>>>"
PARSED = f"book_id string, metadata {META}, chapters array<struct<chapter_no:int,level:int,title:string>>, blocks array<{BLOCK}>, serialised string, is_fixpoint boolean"

#: Characters of books that wait in a task before they go to Spark.
HELD = 4_000_000


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, source): the markdown files of a folder but its readme, named by file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("book_id"), decoded_bytes(F.col("content")).alias("source")).where("book_id <> 'README.md'")


def parsed(books: DataFrame) -> DataFrame:
    """PARSED of books(book_id, source), each read once."""
    importable(books.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)
        for batch in batches:
            rows, size = [], 0
            for book_id, source in zip(batch.column(0), batch.column(1)):
                book_id, source = book_id.as_py(), source.as_py() or ""
                book = M.parsed(source)
                text = M.serialised(book)
                rows.append({"book_id": book_id, "metadata": book["metadata"], "chapters": [{"chapter_no": n, "level": c["level"], "title": c["title"]} for n, c in enumerate(book["chapters"], 1)], "blocks": M.block_rows(book), "serialised": text, "is_fixpoint": M.serialised(M.parsed(text)) == text})
                size += len(source)
                if size >= HELD:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    return books.select(F.col("book_id").cast("string").alias("book_id"), F.col("source").cast("string").alias("source")).mapInArrow(run, PARSED)


def together(files: DataFrame) -> DataFrame:
    """(book_id, source, nothing): the books of files(book_id, file, source), in the order of file names.

    The first file's front matter is the book's. What stands before a file's first heading is a chapter named for the file; files
    without any chapter are listed in nothing. A null source is an empty file."""
    importable(files.sparkSession)

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        out, nothing = [], []
        for k, (file, source) in enumerate(sorted(zip(rows["file"].to_pylist(), rows["source"].to_pylist()), key=lambda x: x[0] or "")):
            lines = (source or "").replace("\r\n", "\n").split("\n")
            _, body = M.front_matter(lines)
            book = M.parsed(source or "")
            if not k:
                out += lines[: len(lines) - len(body)]
            if book["preamble"]:
                out += ["", f"# {(file or '').removesuffix('.md')}", ""]
            if not book["preamble"] and not book["chapters"]:
                nothing.append(file)
            out += ["", *body]
        return pa.table({"book_id": pa.array([key[0].as_py()], pa.string()), "source": pa.array(["\n".join(out)], pa.string()), "nothing": pa.array([nothing], pa.list_(pa.string()))})

    return files.select(F.col("book_id").cast("string").alias("book_id"), "file", "source").groupBy("book_id").applyInArrow(one, "book_id string, source string, nothing array<string>")


def chapters(found: DataFrame) -> DataFrame:
    return found.select("book_id", F.explode("chapters").alias("c")).select("book_id", "c.*")


def blocks(found: DataFrame) -> DataFrame:
    return found.select("book_id", F.explode("blocks").alias("b")).select("book_id", "b.*")


def data_columns(found: DataFrame) -> DataFrame:
    """(book_id, levels, texts, images, links, payload): what every conversion must keep, and the same as JSON.

    How an image is embedded and what a fence holds are format. Links count in titles too."""
    # a book's blocks are in one row, in reading order: what is taken from them stays there, and books are read once
    none = F.array().cast("array<string>")
    ordered = F.array_sort("blocks", lambda a, b: a["block_id"] - b["block_id"])
    own = found.select("book_id", "metadata", F.col("chapters.title").alias("titles"), F.col("chapters.level").alias("levels"), ordered.alias("own"))
    shown = F.filter("own", lambda b: ~b["kind"].isin("fence", "quote", "image"))
    texts = F.flatten(F.transform(shown, lambda b: F.filter(F.concat(F.array(F.coalesce(b["text"], F.lit(""))), F.coalesce(b["items"], none)), lambda x: x != "")))
    pictures = F.transform(F.filter("own", lambda b: b["kind"] == "image"), lambda b: F.struct(b["href"].alias("href"), b["alt"].alias("alt")))
    out = own.select("book_id", "metadata", "titles", "levels", texts.alias("texts"), F.when(F.size(pictures) > 0, pictures).alias("images"))
    hrefs = F.flatten(F.transform(F.concat("titles", "texts"), lambda t: F.regexp_extract_all(t, F.lit(r"\[([^\]\n]+)\]\(([^)\s]+)\)"), F.lit(2))))
    out = out.withColumn("links", hrefs)
    return out.select("book_id", "titles", "levels", "texts", "images", "links", F.to_json(F.struct("metadata", "titles", "levels", "texts", "images", "links")).alias("payload"))
