"""Mixing sources to target weights by capped water-filling.

Sources share the words of all documents by weight. A source whose share is more
than `epochs` times its own words is clamped there, and the excess goes to the
others by weight until none is above. The clamped sources are those of the least
cap per weight, so one pass over the sources in that order finds the water level.

A source then repeats all its documents as often as fits, and fills what is left
with documents in an order drawn by a seeded hash, of which the last is taken in
part: so each source takes its target to the word. The order is found without a
sort of the source: word counts by leading bits of the hash tell the one bucket
in which the draw ends, and only its documents are ranked.

All of it is DataFrame operations. Nulls: a null text has no words; a null source
is a source, the last one. Documents without words are taken zero times (taken 0).
Repeated rows are drawn one by one. An empty table gives an empty result. Columns
beyond doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, join_small, unused, written

SEED = 20_240_607
EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Leading bits of the hash by which a source's words are counted.
BUCKET_BITS = 12


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size and the draw: place (a hash) and bucket (its leading bits)."""
    return docs.withColumns({
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "place": F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text"),
    }).withColumn("bucket", F.shiftrightunsigned("place", 64 - BUCKET_BITS).cast("int"))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to the same with target; one row per source, so few that they are ordered in one task."""
    cap = epochs * F.col("source_size")
    cycle = F.array(*map(F.lit, weights))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(cap / F.col("weight"), "rank")
    before, rest = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    levels = totals.withColumn("rank", F.row_number().over(ordered)).withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumns({
        "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest),
    })
    free = cap > F.col("weight") * F.col("level")
    water = F.max(F.when(free, F.col("level"))).over(everything)
    return levels.select("source", "source_size", F.when(free, F.col("weight") * water).otherwise(cap).cast("double").alias("target"))


def draws(documents: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Per source: target, whole repetitions, and where the part of one ends (bucket, and words wanted from it)."""
    buckets = written(documents.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    goals = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, epochs)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long"))
    goals = written(goals.withColumn("part", F.greatest(F.round(F.col("target") - F.col("whole") * F.col("source_size")), F.lit(0)).cast("long")), "mix-goals")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    own = goals.select(F.col("source").alias("goal_source"), "part")
    ends = join_small(buckets, own, F.col("source").eqNullSafe(F.col("goal_source")), "inner").withColumn("before", upto - F.col("words"))
    ends = ends.where((F.col("before") < F.col("part")) & (F.col("part") <= F.col("before") + F.col("words")))
    ends = ends.select(F.col("goal_source").alias("end_source"), F.col("bucket").alias("end_bucket"), (F.col("part") - F.col("before")).alias("end_words"))
    return written(goals.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left").select("source", "source_size", "target", "whole", F.coalesce("end_bucket", F.lit(-1)).alias("end_bucket"), F.coalesce("end_words", F.lit(0)).alias("end_words")), "mix-draws")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    slim = written(sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")), seed).drop("text"), "mix-sizes")
    return taken(slim, draws(slim, weights, epochs)).select("doc_id", "source", "size", "source_size", "target", "taken")


def taken(documents: DataFrame, drawn: DataFrame) -> DataFrame:
    """documents with source_size, target and taken."""
    goals = drawn.select(F.col("source").alias("goal_source"), *(c for c in drawn.columns if c != "source"))
    out = join_small(documents, goals, F.col("source").eqNullSafe(F.col("goal_source")), "inner")
    inside = F.col("bucket") < F.col("end_bucket")
    settled = out.where(F.col("bucket") != F.col("end_bucket")).withColumn("extra", F.when(inside, F.col("size")).otherwise(0))
    w = Window.partitionBy("goal_source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = out.where(F.col("bucket") == F.col("end_bucket")).withColumn("extra", F.greatest(F.least(F.col("size"), F.col("end_words") - F.sum("size").over(w) + F.col("size")), F.lit(0)))
    return settled.unionByName(last).withColumn("taken", (F.col("whole") * F.col("size") + F.col("extra")).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs as the mix has them: a row for each repetition, the partly taken ones with their first words."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"), F.col("source").cast("string").alias("source"))
    placed = sized(row, seed)
    slim = written(placed.select("doc_id", "source", "size", "place", "bucket"), "mix-sizes")
    drawn = draws(slim, weights, epochs)
    # texts stay where they are: only the few in the last bucket of each source meet for their ranks
    out = taken(placed, drawn)
    copy = unused("copy", docs)
    copies = out.where(F.col("taken") > 0).withColumn(copy, F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    words = F.least(F.col("size"), F.col("taken") - (F.col(copy) - 1) * F.col("size"))
    head = F.when(words == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, words.cast("int")), ""))
    fields = [(head if c == "text" else F.length(head).cast("long") if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return copies.select(*fields)
