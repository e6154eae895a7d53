"""Best-fit packing of tokenised documents into sequences, by linear grouping.

Every document becomes pieces of at most `capacity` tokens. There are at most
`capacity` lengths, so the packing is decided on the counts by length, on the
driver, in memory that doesn't grow with the documents:

1. Lengths over an eighth of the capacity are large. In falling order they are cut
   into groups of equal cardinality, and each is rounded up to its group's largest.
2. For those few sizes, configurations are chosen: again and again the one that
   holds the largest size left and fills a sequence best, as often as it can be had.
3. Actual lengths take the places of the rounded ones, which leaves gaps.
4. Small lengths, falling, go to the fullest sequence that has room.

The plan says which ranks of each length go to which sequences. Pieces get their
ranks within a length by hashed shares of it, so no length meets in one task.

Nulls: a null text is an empty one, whose only token is the end token; a null
doc_id is kept. Repeated rows are packed each. Columns beyond doc_id and text are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_small, mapped, written

CAPACITY = 1024
END_ID = 2
#: Numbers of groups that are tried; the plan with the fewest sequences is taken.
GROUPS = (32, 128, 512)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length that are ranked together, about.
SHARE = 20_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# fixed value: where byte-level tokenizers of this family cut texts
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded by the file's own library alone.
LONG = 1_000_000


class Encoder:
    """Ids of a byte-level tokenizer file. Its vocabulary, where ids follow the order of the
    merges, is read by tiktoken too, which gives the same ids in a third of the time."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"]["add_prefix_space"]
        self.fast = None
        if plain and merged == sorted(merged):
            self.fast = tiktoken.Encoding("file", pat_str=CUTS, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in vocabulary.items()}, special_tokens={})
        self.special = special
        self.marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    @cached_property
    def slow(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or len(text) > LONG:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if not self.special or not any(m in text for m in self.special):
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        parts = [np.array([self.special[p]], np.uint32) if p in self.special else self.fast.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in self.marks.split(text) if p]
        return np.concatenate(parts)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    path = path or tokenizer_path()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, out = encoder(path).ids, []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
            start = 0
            for k, end in enumerate(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)):
                out.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                start = end
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, PIECES)


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Falling lengths with counts, cut into groups of equal cardinality."""
    total, out, room = sum(counts.values()), [], 0
    share = -(-total // groups)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = share
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return out


def configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """How often each size (by index) is used in the fullest sequence that holds the first one left."""
    first = next(i for i, n in enumerate(left) if n)
    room = capacity - sizes[first]
    mask = (1 << (room + 1)) - 1
    reached, trail = 1, []
    for i in range(first, len(sizes)):
        n = min(left[i] - (i == first), room // sizes[i])
        for _ in range(n):
            grown = (reached | reached << sizes[i]) & mask
            if grown == reached:
                break
            trail.append((i, reached))
            reached = grown
        if reached >> room & 1:
            break
    total, used = reached.bit_length() - 1, defaultdict(int, {first: 1})
    for i, before in reversed(trail):
        if not before >> total & 1:
            used[i] += 1
            total -= sizes[i]
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[1]) -> list[tuple[int, tuple[int, ...]]]:
    """(n, lengths): n sequences each hold pieces of these lengths. Uses every piece counted, once."""
    large = {k: n for k, n in counts.items() if k > capacity // 8 and n}
    small = {k: n for k, n in counts.items() if k <= capacity // 8 and n}
    stacks = grouped(large, groups) if large else []
    sizes, left = [s[0][0] for s in stacks], [sum(n for _, n in s) for s in stacks]
    for s in stacks:
        s.reverse()  # the largest is popped first
    bins: dict[int, list[list]] = defaultdict(list)  # room: [n, lengths]
    while any(left):
        used = configuration(sizes, left, capacity)
        times = min(left[i] // n for i, n in used.items())
        for i, n in used.items():
            left[i] -= n * times
        slots = [i for i, n in used.items() for _ in range(n)]
        # a slot takes `times` pieces of its group in turn, so equal lengths stay together
        runs = []
        for i in slots:
            need, run = times, []
            while need:
                length, n = stacks[i].pop()
                got = min(n, need)
                run.append((length, got))
                if n > got:
                    stacks[i].append((length, n - got))
                need -= got
            runs.append(run[::-1])
        while runs and runs[0]:
            n = min(r[-1][1] for r in runs)
            lengths = tuple(r[-1][0] for r in runs)
            bins[capacity - sum(lengths)].append([n, lengths])
            for r in runs:
                length, had = r.pop()
                if had > n:
                    r.append((length, had - n))
    rooms = sorted(r for r in bins if bins[r])
    for length in sorted(small, reverse=True):
        need = small[length]
        while need:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                bisect.insort(rooms, capacity)
                bins[capacity].append([-(-need // (capacity // length)), ()])
                continue
            room = rooms[at]
            entry = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            n = min(entry[0], need)
            # as many of this length as one sequence takes, as best fit would put them
            each = min(room // length, need // n)
            if entry[0] > n:
                if not bins[room]:
                    bisect.insort(rooms, room)
                bins[room].append([entry[0] - n, entry[1]])
            if not bins[room - each * length]:
                bisect.insort(rooms, room - each * length)
            bins[room - each * length].append([n, entry[1] + (length,) * each])
            need -= n * each
    return [(n, lengths) for entries in bins.values() for n, lengths in entries if lengths]


def places(planned: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """By length and rank: ranks from `rank` on of `length` go to sequences from `sequence` on, at `offset`."""
    upto: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, lengths in planned:
        offset = 0
        for length in lengths:
            rows.append((length << 44 | upto[length], upto[length], sequence, offset))
            upto[length] += n
            offset += length
        sequence += n
    found = np.array(sorted(rows) or [(0, 0, 0, 0)], np.int64)
    return dict(zip(("key", "rank", "sequence", "offset"), found.T))


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, path: str | None = None) -> DataFrame:
    """The pieces with their sequence_id and offset."""
    cut = written(pieces(docs, capacity, path), "pack-pieces")
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = places(min((plan(by_length, capacity, g) for g in groups), key=lambda p: sum(n for n, _ in p)))
    shares = max(64, sum(by_length.values()) // SHARE)
    dealt = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)).cast("int"))
    sums = Window.partitionBy("length").orderBy("share")
    before = written(dealt.groupBy("length", "share").agg(F.count("*").alias("n")).select("length", "share", (F.sum("n").over(sums) - F.col("n")).alias("before")), "pack-shares")
    own = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = join_small(dealt.withColumn("own", F.row_number().over(own) - 1), before, ["length", "share"], "inner")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).cast("long").alias("rank"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(i).to_numpy() for i in (3, 5))
        at = np.searchsorted(where["key"], length << 44 | rank, "right") - 1
        sequence = where["sequence"][at] + rank - where["rank"][at]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(where["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return mapped(ranked, rows, f"{PIECES}, sequence_id long, offset long")
