"""A landing folder as a stream: files arrive whole, are checked and claimed once.

Byte caps and signatures are checks of whole files (uploads in pieces are in `uploads`);
a content is claimed by the first file that has it, whenever that file was modified; and
every file has one outcome, refused and repeated ones too, written once per batch. Batch
and stream share the same functions, so a replay of a folder gives what the stream gave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import basename, is_pdf
from quire.streaming.uploads import once

MOST = 512 * 1024 * 1024
REFUSED_KEYS = 32


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.pdf", archive: str | None = None) -> DataFrame:
    """Files of a folder as they come: path, modificationTime, length, content.

    A file is taken however old it is: by default the source would pass over those much older than the newest it has seen.
    It remembers all files it has taken for that, so a folder that goes on for years names an `archive` to which they move."""
    schema = spark.read.format("binaryFile").load(folder).schema
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFileAge", "36500d")
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.load(folder)


def checked(files: DataFrame, most: int = MOST) -> DataFrame:
    """files with the reason for which an upload is refused, null if it isn't."""
    return files.withColumn("refused", F.when(F.col("length") > most, "too large").when(F.col("length") == 0, "empty").when(~is_pdf(F.col("content"), most), "not a PDF"))


def accepted(files: DataFrame, most: int = MOST) -> DataFrame:
    """(upload_id, path, length, modificationTime) of the uploads that may be taken; contents stay where they are."""
    return checked(files, most).where("refused is null").select(F.sha2("content", 256).alias("upload_id"), "path", basename(F.col("path")).alias("name"), "length", "modificationTime")


def ledger(files: DataFrame, most: int = MOST) -> DataFrame:
    """(path, name, length, modificationTime, upload_id, outcome, holder) of every file of a stream: "accepted", "repeated" where its content was
    taken before (holder: the file that has it), or why it is refused. Contents stay where they are."""
    own = checked(files, most).select("path", basename(F.col("path")).alias("name"), "length", "modificationTime", F.sha2("content", 256).alias("upload_id"), "refused")
    # a refused file claims nothing: some keys serve all of them, so that they leave no state and cost no group each
    keyed = own.withColumn("claim", F.when(F.col("refused").isNull(), F.col("upload_id")).otherwise(F.concat(F.lit("refused "), F.pmod(F.xxhash64("path"), F.lit(REFUSED_KEYS)).cast("string"))))
    outcome = F.coalesce("refused", F.when(F.col("first"), "accepted").otherwise("repeated"))
    found = once(keyed, "claim", ["path"], "path")
    return found.select("path", "name", "length", "modificationTime", F.when(F.col("refused").isNull(), F.col("upload_id")).alias("upload_id"), outcome.alias("outcome"), F.when(F.col("refused").isNull(), F.col("holder")).alias("holder"))


def empty_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """The same columns for files without a byte: the file source passes over them, so they are found by listing the folder, as often as asked."""
    from fnmatch import fnmatch

    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    found = [i for i in files.get_file_info(fs.FileSelector(root)) if i.is_file and not i.size and fnmatch(i.base_name, pattern)]
    rows = [(f"{folder.rstrip('/')}/{i.base_name}", i.base_name, 0, i.mtime, None, "empty", None) for i in found]
    return spark.createDataFrame(rows, "path string, name string, length long, modificationTime timestamp, upload_id string, outcome string, holder string")


def claims(events: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Of a finished table: the event that got each key, and how many later ones were refused."""
    return events.groupBy(key).agg(F.min_by(tie, F.struct(time, tie)).alias(tie), (F.count("*") - 1).alias("refused"))


def converted(stream: DataFrame, convert: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, once_through: bool = True):
    """Runs a batch conversion over arrivals; each batch overwrites its own folder, so a repeated batch leaves one outcome."""

    def batch(rows: DataFrame, number: int) -> None:
        convert(rows).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once_through else writer).start()
