"""The queries opN_<name> and the pipeline, with SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm, mixing, packing, pii, quality, resampling, simhash, spfhp, suffix, tokens, topk, toxicity, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The key of surrogates where the session sets none: good for test data alone, whose persons are invented.
TEST_KEY = "of the test tables"


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get(pii.KEY_SETTING, None) or TEST_KEY


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.score(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets alone: what of the mix doesn't hang on the draw, for SQL to confirm."""
    mix = mixing.mix(table(spark, sf_dir, "documents"))
    return mix.groupBy("source", "source_size").agg(F.count("*").alias("n_documents"), F.round(F.max("target"), 3).alias("target"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.transform("found", lambda x: x["kind"])
    return pii.counted(docs, surrogate_key(spark)).select("doc_id", "text", F.size("found").alias("n_found"), *(F.size(F.array_intersect(kinds, F.array(F.lit(k)))).alias(f"has_{k}") for k in pii.KINDS))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op11_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact scatter alone, for SQL to confirm."""
    return whitening.scatter_entries(table(spark, sf_dir, "embeddings"))


def op12_spfhp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spfhp.pack(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_lm_scoring, op4_exact_top_k, op5_suffix_dedup, op6_token_counts, op7_source_mixing, op7_targets, op8_pii_surrogates, op9_best_fit_packing, op10_simhash_classes, op11_embedding_whitening, op11_scatter, op12_spfhp_packing, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
