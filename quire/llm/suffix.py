"""Repeated byte strings by distributed prefix doubling.

The suffix order of a corpus up to `length` bytes tells which strings of that length
start in more than one place. Prefix doubling names the strings of one length at every
position, then those of twice the length by the pair of names at the position and at
that offset, and so on. Names here are hashes of the pairs, not places in a sorted
list, so the doublings from 1 to 128 bytes need no exchange; ranks, that is, whether a
name is unique, are settled where it can drop most positions:

1. At 128 bytes, only for positions that every string of `length` bytes around them
   would choose alike: the least name of each run of positions (winnowing). A string
   that starts twice has the same choice twice; where a chosen name is unique, all
   strings that chose it are, and they are dropped.
2. At the full length, by the pair of names at a position and at the end less 128, for
   the positions that are left. Unique ones are dropped; the rest are repeats.

Names that are asked are 64 bits long: two strings that differ pass for equal once in
some 10^19 pairs of asked positions (README). Each time Spark sorts the asked names
within hash buckets over all documents (see blocks). Whole texts that are copies are
settled in the first exchange, and only the first copy asks further, with double
weight. Every exchange sends a name once per block of documents, so no frequent passage
meets in one task.

Nulls are empty texts. A null doc_id is kept. Texts shorter than `length` have no
repeats. Repeated rows are documents of their own, and thus copies. Columns beyond
doc_id and text are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .common import mix64

LENGTH = 200
#: The length at which chosen positions are ranked first.
NAMED = 128
BLOCK = 4_000_000
#: Bytes that are named at once.
SLAB = 1 << 17
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The names of pairs of names."""
    x = a * FACTOR + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def extreme(values: np.ndarray, width: int, of) -> np.ndarray:
    """The least or largest of each `width` values in a row, by doubling."""
    have = 1
    while have * 2 <= width:
        values = of(values[:-have], values[have:])
        have *= 2
    return of(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


class Names:
    """Names within texts laid side by side; a start is a position where a string of the full length begins."""

    def __init__(self, texts: list[bytes], length: int, named: int) -> None:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        self.sizes, self.ends = sizes, ends
        names, have = mix64(raw.astype(np.uint64) + np.uint64(1)), 1
        while have < named:
            names = paired(names[:-have], names[have:])
            have *= 2
        n = len(raw) - length + 1
        self.whole = paired(names[:n], names[length - named : length - named + n])
        starts = np.ones(n, bool)
        for end in ends[:-1]:
            starts[max(0, end - length + 1) : end] = False
        width = length - named + 1
        choice = extreme(names, width, np.minimum)[:n]
        self.starts = starts
        # a position is chosen if it has the least name of some start's run
        shown = np.concatenate([np.zeros(width - 1, np.uint64), np.where(starts, choice, np.uint64(0)), np.zeros(width - 1, np.uint64)])
        chosen = extreme(shown, width, np.maximum)
        # least names are small: scrambled, they spread over all buckets
        self.chosen = mix64(names[: len(chosen)][names[: len(chosen)] == chosen])
        self.choice = mix64(choice)


def slabs(texts: list[bytes], length: int, slab: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(number of the text, offset, piece) of all that can hold a repeat, a slab at a time.

    A long text is cut into pieces that overlap, so that each start is in one of them, whole."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, slab):
            held.append((k, at, t[at : at + slab + length - 1]))
            size += len(held[-1][2])
            if size >= slab:
                yield held
                held, size = [], 0
    if held:
        yield held


def whole_key(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text, 7)


def remove(docs: DataFrame, length: int = LENGTH, named: int = NAMED, characters: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    if named & named - 1 or not named <= length <= 2 * named:
        raise ValueError("named must be a power of two of at least half the length, and at most the length")
    held = B.blocks(docs, "suffix-blocks", characters)
    n_blocks = held.count()
    bits = B.bucket_bits(n_blocks)
    nothing = hashlib.sha256(b"").hexdigest()

    def first_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of a block's first question with counts: chosen names, and long texts whole."""
        found = [np.array([whole_key(t) for t in texts if len(t) >= length], np.uint64)]
        found += [Names([piece for _, _, piece in some], length, named).chosen for some in slabs(texts, length, slab)]
        return np.unique(np.concatenate(found), return_counts=True)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = first_keys([t.encode("utf-8", "surrogatepass") for t in B.documents_of(payload.as_py())[1]])
                yield B.ask_batch(B.asked(block, keys, np.minimum(counts, 2), bits))

    def second(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        """A block's second question, and its documents with what is known of them, under a key of its own."""
        block = own["block"][0].as_py()
        ids, texts = B.documents_of(own["payload"][0].as_py())
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        keys, _ = first_keys(raw)
        answer = B.told(answers)
        common = keys[answer > 0]
        state = np.zeros(len(raw), np.int8)  # 0: nothing repeats, 1: a copy, 2: the first of copies, 3: open
        seen: set[int] = set()
        for k, t in enumerate(raw):
            if len(t) >= length:
                key_ = whole_key(t)
                told = answer[np.searchsorted(keys, np.uint64(key_))]
                if told:
                    state[k] = 2 if told == 2 and key_ not in seen else 1
                    seen.add(key_)
        questions: list[list[np.ndarray]] = [[], []]  # of open texts, and of first copies
        for some in slabs([t if state[k] != 1 else b"" for k, t in enumerate(raw)], length, slab):
            names = Names([piece for _, _, piece in some], length, named)
            left = names.starts & member(names.choice, common)
            bounds = np.concatenate([[0], names.ends])
            for (k, _, _), a, b in zip(some, bounds, bounds[1:]):
                mine = left[a:b]
                if mine.any():
                    questions[int(state[k] == 2)].append(names.whole[a : a + len(mine)][mine])
                    state[k] = state[k] or 3
        rows = []
        if questions[0]:
            asked, counts = np.unique(np.concatenate(questions[0]), return_counts=True)
            rows += B.asked(block, asked, np.minimum(counts, 2), bits)
        if questions[1]:  # copies repeat: their names count twice, and need no answer
            asked = np.unique(np.concatenate(questions[1]))
            rows += B.asked(-1 - block, asked, np.full(len(asked), 2), bits)
        told = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(state), pa.array([r if s == 3 else None for r, s in zip(raw, state)], pa.binary()), pa.array([hashlib.sha256(r).hexdigest() if not s else None for r, s in zip(raw, state)], pa.string())], ["doc_id", "n_bytes", "state", "open", "sha256"])
        rows.append((-1 - block, block, B.framed(told), B.packed(common)))
        return pa.Table.from_batches([B.ask_batch(rows)])

    def answer(key: tuple, bucket: pa.Table) -> pa.Table:
        return B.answered(bucket, first=True) if key[0].as_py() >= 0 else bucket

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")  # the block's own row is first
        told = B.unframed(rows["keys"][0].as_py()).to_pydict()
        common = B.unpacked(rows["counts"][0].as_py())
        texts = [t or b"" for t in told["open"]]

        def asked() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """Number of the text, starts that were asked about, and their names."""
            for some in slabs(texts, length, slab):
                names = Names([piece for _, _, piece in some], length, named)
                left = names.starts & member(names.choice, common)
                bounds = np.concatenate([[0], names.ends])
                for (k, offset, _), a, b in zip(some, bounds, bounds[1:]):
                    at = np.flatnonzero(left[a:b])
                    yield k, offset + at, names.whole[a + at]

        repeated = np.zeros(0, np.uint64)
        edges: dict[int, np.ndarray] = {}
        if any(texts):
            repeated = np.unique(np.concatenate([np.unique(x) for _, _, x in asked()]))[B.told(rows.slice(1)) > 0]
            for k, at, whole in asked():
                at = at[member(whole, repeated)]
                own = edges.setdefault(k, np.zeros(len(texts[k]) + 1, np.int8))
                own[at] += 1
                own[at + length] -= 1
        n_removed, n_spans, sha = [], [], []
        for k, (n, state, text, digest) in enumerate(zip(told["n_bytes"], told["state"], told["open"], told["sha256"])):
            gone = np.zeros(n, bool)
            if state == 3:
                gone = np.cumsum(edges[k][:-1], dtype=np.int32) > 0
                digest = hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()
            elif state:
                gone[:], digest = True, nothing
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()))
            sha.append(digest)
        return pa.table({"doc_id": pa.array(told["doc_id"], pa.int64()), "n_bytes": pa.array(told["n_bytes"], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    by = lambda rows, key: B.dealt(rows, key, n_blocks).groupBy(key)
    first = by(held.mapInArrow(ask, B.ASK), "bucket").applyInArrow(answer, B.ASK)
    then = by(held, "block").cogroup(by(first, "block")).applyInArrow(second, B.ASK)
    return by(by(then, "bucket").applyInArrow(answer, B.ASK), "block").applyInArrow(finish, SPANS)


def member(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values
