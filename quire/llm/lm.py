"""Stupid-backoff language-model scores, with count tables partitioned by hash.

N-grams of all orders up to the model's are hashed, exploded from every document and
counted in tables partitioned by hash; the counts are joined back to the n-grams and
log scores are summed per document. Rows of the exchange are blocks of n-grams, not
single ones (see blocks): the same joins, with sorting, adding and looking up done on
arrays, and an n-gram sent once per block that has it.

A document is scored by the counts of all others: its own are taken off, as else
every n-gram would have been seen. A word scores c(context word) / c(context) where
the n-gram occurs elsewhere, else BACKOFF times its score in the next shorter context;
a word that occurs nowhere else scores as if seen half a time.

Words are runs of anything but ASCII white space, A-Z in lower case. Null and empty
texts have no words, score sum 0 and mean null. A null doc_id is kept; repeated rows
are documents each, and others to one another. Columns beyond doc_id and text are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import WORD, mix64

#: Bigrams: with trigrams too, the exchanged keys take 4.6 times the space of the input on disk, instead of 3.1.
ORDER = 2
#: Characters of a block: larger ones share more keys, and take more of a worker's memory.
CHARACTERS = 5_000_000
BACKOFF = 0.4
UNSEEN = 0.5
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCORES = "doc_id long, n_words long, n_backed_off long, log_score double, mean_log_score double"


def grams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per text; and per order the n-gram keys of all texts in turn, and where each n-gram ends."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}
    sizes, flat = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        sizes.append(len(words))
        for w in words:
            if w not in known:
                known[w] = xxh64_intdigest(w)
        flat.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    lengths = np.array(sizes, np.int64)
    words = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys, ends = [mix64(words)], [np.arange(len(words))]
    run = words
    for n in range(2, order + 1):
        run = mix64(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :] + np.uint64(n))
        whole = place[n - 1 :] >= n - 1
        keys.append(run[whole])
        ends.append(np.arange(n - 1, len(words))[whole])
    return lengths, keys, ends


def scored(texts: list[str], totals: np.ndarray, tokens: int, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, backed-off words and log score of each text of a block, given the totals of its distinct n-grams."""
    lengths, keys, ends = grams(texts, order)
    document = np.repeat(np.arange(len(texts)), lengths)
    inverse = np.unique(np.concatenate(keys), return_inverse=True)[1]
    others = []
    at = 0
    for n in range(order):
        own = inverse[at : at + len(keys[n])]
        at += len(own)
        pair, back, counts = np.unique(document[ends[n]] * np.int64(len(totals) + 1) + own, return_inverse=True, return_counts=True)
        left = np.zeros(len(document), np.int64)
        left[ends[n]] = totals[own] - counts[back]
        others.append(left)
    rest = np.maximum(tokens - lengths[document], 1).astype(float)
    score = np.where(others[0] > 0, others[0], UNSEEN) / rest
    shorter = np.zeros(len(document), bool)
    for n in range(1, order):
        seen = others[n] > 0
        context = np.empty(len(document))
        context[1:] = others[n - 1][:-1]
        usable = np.zeros(len(document), bool)
        usable[ends[n]] = True  # fewer words stand before the others
        score = np.where(seen, others[n] / np.where(seen, context, 1), np.where(usable, backoff * score, score))
        shorter = usable & ~seen
    logs = np.log(score)
    sums = np.bincount(document, weights=logs, minlength=len(texts))
    return lengths, np.bincount(document, weights=shorter, minlength=len(texts)).astype(np.int64), sums.astype(float)


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, characters: int = CHARACTERS) -> DataFrame:
    """(doc_id, n_words, n_backed_off, log_score, mean_log_score) of every document."""
    held = B.blocks(docs, "lm-blocks", characters)
    n_blocks = held.count()
    bits = B.bucket_bits(n_blocks)
    by = lambda rows, key: B.dealt(rows, key, n_blocks).groupBy(key)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, keys, _ = grams(B.documents_of(payload.as_py())[1], order)
                found, counts = np.unique(np.concatenate(keys), return_counts=True)
                yield B.ask_batch(B.asked(block, found, counts, bits))

    def answer(key: tuple, bucket: pa.Table) -> pa.Table:
        return B.answered(bucket)

    totals = by(held.mapInArrow(ask, B.ASK), "bucket").applyInArrow(answer, B.ASK)
    tokens = docs.select(F.sum(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))).alias("n")).collect()[0]["n"] or 0

    def finish(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = B.documents_of(own["payload"][0].as_py())
        lengths, shorter, sums = scored(texts, B.told(answers), tokens, order, backoff)
        mean = np.where(lengths > 0, sums / np.maximum(lengths, 1), np.nan)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": lengths, "n_backed_off": shorter, "log_score": sums, "mean_log_score": pa.array(mean, from_pandas=True)})

    return by(held, "block").cogroup(by(totals, "block")).applyInArrow(finish, SCORES)
