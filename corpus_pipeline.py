"""A corpus from raw documents to packed sequences: five stages, each of which works
on all that the one before it kept, as Parquet written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, packing, pii, quality, simhash
from quire.llm.common import own_dir, table
from quire.llm.queries import surrogate_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.one_of_each(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become surrogates, by the session's key."""
    return pii.replaced(docs, surrogate_key(spark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the source targets ask for."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("simhash", near_duplicates), ("pii", surrogates), ("mixing", source_mix), ("packing", packed_sequences)]

#: Fingerprint components, keyed surrogates and token ids aren't expressible in DuckDB SQL; tests/llm has a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{own_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
