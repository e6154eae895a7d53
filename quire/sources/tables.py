"""Small tables that come as files: class maps, names of pictographs, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import basename
from quire.functions.text import code_point_label, decoded_bytes


def json_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) of a JSON object of strings."""
    text = spark.read.format("binaryFile").load(path).select(decoded_bytes(F.col("content")).alias("t"))
    return text.select(F.explode(F.from_json("t", "map<string,string>")).alias(key, value))


def class_map(spark: SparkSession, path: str) -> DataFrame:
    return json_map(spark, path, "site_class", "book_class")


def pictograph_names(spark: SparkSession, path: str) -> DataFrame:
    """(glyph, name): names of pictographs in one language, from the annotations' JSON: {annotations: {annotations: {glyph: {tts: [name]}}}}."""
    text = spark.read.format("binaryFile").load(path).select(decoded_bytes(F.col("content")).alias("t"))
    found = F.from_json("t", "struct<annotations:struct<annotations:map<string,struct<tts:array<string>>>>>")
    return text.select(F.explode(found["annotations"]["annotations"]).alias("glyph", "x")).select("glyph", F.element_at("x.tts", 1).alias("name"))


def named(glyphs: DataFrame, names: DataFrame) -> DataFrame:
    """glyphs(glyph) with their name, looked up with and without the variation selector; else their code point."""
    bare = lambda c: F.replace(c, F.lit("️"), F.lit(""))
    known = names.groupBy(bare(F.col("glyph")).alias("bare")).agg(F.min("name").alias("known"))
    return glyphs.withColumn("bare", bare(F.col("glyph"))).join(known, "bare", "left").select(*glyphs.columns, F.coalesce("known", code_point_label(F.col("bare"))).alias("name"))


def wrong_checksums(files: DataFrame, pins: DataFrame) -> DataFrame:
    """(name, error): files(path, content) that differ from pins(name, sha256), and pins without a file."""
    own = files.select(basename(F.col("path")).alias("name"), F.sha2("content", 256).alias("own"))
    joined = pins.join(own, "name", "left")
    return joined.select("name", F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.lower("sha256"), "another checksum").alias("error")).where("error is not null")


def rewritten_prefix(ref: Column, rewrites: dict[str, str]) -> Column:
    """A reference with the longest of the prefixes it has replaced."""
    out = ref
    for old, new in sorted(rewrites.items(), key=lambda kv: len(kv[0])):
        out = F.when(ref.startswith(old), F.concat(F.lit(new), F.substring(ref, len(old) + 1, 1 << 30))).otherwise(out)
    return out
