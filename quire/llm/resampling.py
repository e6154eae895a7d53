"""Importance resampling of documents towards a target distribution, by hashed n-gram counts.

Features of a text are its runs of one to `ORDER` = 2 consecutive words, each in a bucket
by the CRC-32 of its bytes. Tasks read texts chunk by chunk into tries of words: a node of
the first level is a word, a node of the second a word after it. Nodes hold how often
their feature occurs and the CRC state that the path to them leaves: a child's state goes
on from its parent's, with a blank and the child's word, so no feature is ever spelled
out. A task's nodes add up to bucket totals, tasks' totals are merged by Spark, and each
bucket gets a gain, the floored log ratio of its smoothed shares in target and corpus. In
a second pass gains are attached to the nodes of the same tries, and a document's weight
is the floored mean of what its words pick up as they walk the tries.

Documents are drawn without replacement by weight and seeded Gumbel noise: the highest
scores among documents of enough words. Ranks come from a sort by ranges, of which each
is numbered by itself, so no task sees all documents.

Nulls: a null text has no words; a null id is hashed as if it were empty, and comes last
among equal scores. Repeated rows are counted, scored and drawn each. Columns beyond
doc_id and text are ignored. An empty target gives gains by the corpus alone; an empty
corpus gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import importable, join_small, unused, written

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text in a trie, or one document: what a task holds doesn't grow with its partition.
CHUNK = 1_500_000
#: Rows that one task sorts and numbers, about.
RANGE = 500_000

#: ASCII upper case to lower case; all bytes outside 0-9, a-z and beyond ASCII to blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@cache
def zeros(power: int) -> np.ndarray:
    """What 2^power zero bytes do to a CRC state, by its bytes: four tables of 256."""
    if not power:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
        rows = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
        return np.stack([step[r & 255] ^ r >> 8 for r in rows])
    half = zeros(power - 1)
    return np.stack([passed(half, row) for row in half])


def passed(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    return table[0][states & 255] ^ table[1][states >> 8 & 255] ^ table[2][states >> 16 & 255] ^ table[3][states >> 24]


def continued(states: np.ndarray, tails: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of texts with these CRCs, each followed by a tail of this CRC and length."""
    states = states.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> power & 1)
        states[at] = passed(zeros(power), states[at])
    return states ^ tails


class Trie:
    """The words of some texts: first level by word, second by (word, word after it)."""

    def __init__(self, texts: list[bytes | None]) -> None:
        words: list[bytes] = []
        ends = []
        for text in texts:
            if text:
                words += text.translate(FOLD).split()
            ends.append(len(words))
        self.ends = np.array(ends, np.int64)
        self.n_words = np.diff(self.ends, prepend=0)
        #: per word its node in the first level; per word after the first, its node in the second
        first = pa.array(words, pa.binary()).dictionary_encode()
        self.first = first.indices.to_numpy().astype(np.int64)
        names = first.dictionary.to_pylist()
        inner = np.ones(max(len(words) - 1, 0), bool)
        inner[self.ends[(self.ends > 0) & (self.ends < len(words))] - 1] = False  # no run crosses from one text to the next
        self.inner = np.flatnonzero(inner)
        second = pa.array(self.first[self.inner] << 32 | self.first[self.inner + 1]).dictionary_encode()
        self.second = second.indices.to_numpy().astype(np.int64)
        paths = second.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.array([zlib.crc32(w) for w in names], np.uint32)
        lengths = np.array([len(w) for w in names], np.int64)
        parent, child = paths >> 32, paths & 0xFFFFFFFF
        blank = continued(own, np.full(len(own), zlib.crc32(b" "), np.uint32), np.ones(len(own), np.int64))
        #: CRC states of the nodes of both levels
        self.states = own, continued(blank[parent], own[child], lengths[child])

    def totals(self, buckets: int) -> np.ndarray:
        """Features by bucket: each node counts as often as its path was walked."""
        out = np.zeros(buckets, np.int64)
        for states, walked in zip(self.states, (self.first, self.second)):
            counts = np.bincount(walked, minlength=len(states))
            out += np.bincount(states.astype(np.int64) % buckets, weights=counts, minlength=buckets).astype(np.int64)
        return out

    def walked(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the number of its features and the sum of the gains attached to its paths' nodes."""
        first, second = (gains[s.astype(np.int64) % len(gains)] for s in self.states)
        sums = np.zeros(len(self.first) + 1, np.int64)
        sums[1:] = first[self.first]
        sums[self.inner + 2] += second[self.second]
        sums = np.cumsum(sums)[self.ends]
        return self.n_words + np.maximum(self.n_words - 1, 0), np.diff(sums, prepend=0)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes | None]]]:
    """Ids and texts (as bytes), some megabytes at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1] or b"")
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def bucket_totals(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; what is collected has one row for each bucket."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for _, texts in chunks(batches):
            totals += Trie(texts).totals(buckets)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at])], ["bucket", "n"])

    own = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = np.zeros(buckets, np.int64)
    for r in own.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, by bucket."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches):
            trie = Trie(texts)
            features, sums = trie.walked(gains)
            weight = np.floor_divide(sums, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(trie.n_words), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_scores(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows with score: the weight and Gumbel noise drawn by the id's hash."""
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0)))
    return rows.withColumn("score", (F.col("weight") + noise).cast("long"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with rank, from 1: sorted by ranges, each numbered by itself. Equal rows may meet in several ranges."""
    importable(rows.sparkSession)
    own = written(rows.withColumn("row", F.monotonically_increasing_id()), f"{name}-rows")
    ranges = max(1, own.count() // RANGE + 1)
    columns = [*own.columns, "task", "own"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], columns)
            at += n

    # the row's number ends the order, so equal keys split too
    dealt = own.repartitionByRange(ranges, *order, "row").sortWithinPartitions(*order, "row")
    # written: which row stands where is settled once
    placed = written(dealt.mapInArrow(number, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in own.schema)}, task int, own long"), f"{name}-ranges")
    # a row per range
    before = placed.groupBy("task").agg(F.count("*").alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    joined = join_small(placed, written(before, f"{name}-before"), "task", "inner")
    return joined.withColumn("rank", F.col("before") + F.col("own") + 1).drop("row", "task", "own", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn."""
    gains = gains_of(bucket_totals(docs, buckets), bucket_totals(target, buckets))
    scored = written(with_scores(weighed(docs, gains), seed), "resample-scores")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    ranks = numbered(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id")], "resample")
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranks.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns; rows that share an id are drawn together."""
    key = unused("drawn_id", docs)
    found = resample(docs, target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias(key))
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_semi")
