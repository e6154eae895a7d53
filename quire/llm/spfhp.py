"""Packing of tokenised documents by shortest-pack-first over the length histogram.

Documents become pieces of at most `capacity` tokens: whole ones, and of longer ones
full pieces and a rest. The packing is decided on the counts by length, on the driver,
in memory that doesn't grow with the documents: lengths are placed longest first, each
into the pattern of packs that are shortest so far (have most room), and where none has
room new packs are begun. What comes out are patterns with how often each is used; they
are joined back to pieces by length and rank within the length.

Packs are padded to the capacity, but not at a power of two, so what is left of them
are gaps. Pieces may be cut, so gaps needn't be padded: before the packing, a share of
the documents just large enough is set aside by a hash of the row. Their tokens, one
after the other, run through the gaps of all packs, then through full sequences, and
the last tokens through sequences of powers of two. So nothing at all is padded, and
only documents set aside (and those longer than a sequence) are cut. They are tokenised
a second time, in which their places in the run are known, instead of keeping the ids
of all documents.

Nulls: a null text is an empty one, whose only token is the end token; a null doc_id is
kept. Repeated rows are packed each. Columns beyond doc_id and text are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import importable, join_small, mapped, written
from .packing import SHARE, encoder, tokenizer_path

CAPACITY = 2048
END_ID = 1
#: Parts of the hash of a row; a share set aside is a number of them.
PARTS = 1 << 20
SEED = 12
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def part() -> Column:
    """The part of the hash in which a row (doc_id, text) is."""
    return F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(PARTS)).cast("int")


def slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def ids_of(text: str | None, path: str) -> np.ndarray:
    return np.append(encoder(path).ids(text or ""), END_ID).astype("<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, part) of every document's pieces."""
    path = path or tokenizer_path()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            ids = ids_of(text.as_py(), path)
            for start in range(0, len(ids), capacity):
                cut = ids[start : start + capacity]
                out.append((doc_id, start, len(cut), zlib.crc32(cut.tobytes()), len(ids), own))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.int32()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"])

    return mapped(slim(docs).withColumn("part", part()), rows, f"{PIECES}, part int")


def gap(total: int, capacity: int) -> int:
    """What is padded of a pack."""
    return 0 if total & (total - 1) == 0 else capacity - total


def shortest_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(n, ((length, times), ...)): n packs each hold these lengths, as placed. Uses every piece counted, once."""
    packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by room
    rooms: list[int] = []  # negative, the largest room first

    def put(room: int, n: int, pattern: tuple) -> None:
        if not packs[room]:
            heapq.heappush(rooms, -room)
        packs[room].append((n, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                n, pattern = packs[room].pop()
                if not packs[room]:
                    heapq.heappop(rooms)
                if n > left:
                    put(room, n - left, pattern)
                    n = left
                times = pattern[-1][1] + 1 if pattern[-1][0] == length else 1
                put(room - length, n, (pattern[:-1] if times > 1 else pattern) + ((length, times),))
                left -= n
            else:  # begun packs take as many of this length as would go one by one
                times = min(left, capacity // length)
                n = left // times
                put(capacity - length * times, n, ((length, times),))
                left -= n * times
    return [entry for entries in packs.values() for entry in entries]


class Plan:
    """Where pieces and the run of tokens set aside go."""

    def __init__(self, packed: list[tuple[int, tuple[tuple[int, int], ...]]], capacity: int) -> None:
        self.capacity = capacity
        upto: dict[int, int] = defaultdict(int)
        rows, gaps, sequence, filled = [], [], 0, 0
        for n, pattern in packed:
            offset = 0
            for length, times in pattern:
                rows.append((length << 44 | upto[length], upto[length], times, sequence, offset))
                upto[length] += n * times
                offset += length * times
            if room := gap(offset, capacity):
                gaps.append((filled, room, sequence, offset))
                filled += n * room
            sequence += n
        key = np.array(sorted(rows) or [(0, 0, 1, 0, 0)], np.int64)
        self.key, self.rank, self.times, self.sequence, self.offset = key.T
        #: by first token of the run: room of each pack, its sequence, its length so far
        self.gaps = np.array(gaps or [(0, 1, 0, 0)], np.int64)
        self.filled, self.sequences = filled, sequence

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequences and offsets of pieces by length and rank."""
        at = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        own = rank - self.rank[at]
        return self.sequence[at] + own // self.times[at], self.offset[at] + own % self.times[at] * length

    def runs(self, first: int, tokens: int, total: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document of so many tokens, which has place `first` in a run of `total`."""
        x, end = first, first + tokens
        whole = self.filled + (total - self.filled) // self.capacity * self.capacity
        while x < end:
            if x < self.filled:
                begun, room, sequence, offset = self.gaps[np.searchsorted(self.gaps[:, 0], x, "right") - 1].tolist()
                k, within = divmod(x - begun, room)
                sequence, offset, left = sequence + k, offset + within, room - within
            elif x < whole:
                k, within = divmod(x - self.filled, self.capacity)
                sequence, offset, left = self.sequences + k, within, self.capacity - within
            else:
                rest, begun, sequence = total - whole, whole, self.sequences + (whole - self.filled) // self.capacity
                size = 1 << (rest.bit_length() - 1)
                while x >= begun + size:
                    begun, rest, sequence = begun + size, rest - size, sequence + 1
                    size = 1 << (rest.bit_length() - 1)
                offset, left = x - begun, begun + size - x
            n = min(left, end - x)
            yield x - first, n, sequence, offset
            x += n


def planned(cut: DataFrame, capacity: int) -> tuple[Plan, int, int]:
    """The plan, the number of parts set aside, and the tokens in them."""
    total, share = 0, 0
    while True:
        # at most 2 * capacity rows
        found = cut.groupBy("length", (F.col("part") < share).alias("aside")).agg(F.count("*").alias("n")).collect()
        plan = Plan(shortest_first({r["length"]: r["n"] for r in found if not r["aside"]}, capacity), capacity)
        total = total or sum(r["length"] * r["n"] for r in found)
        aside = sum(r["length"] * r["n"] for r in found if r["aside"])
        if aside >= plan.filled:
            return plan, share, aside
        share = min(PARTS, max(2 * share, int(1.1 * plan.filled / total * PARTS) + 1))


def ranked(cut: DataFrame) -> DataFrame:
    """Pieces with their ranks within their length, from 0: by hashed shares of it, so no length meets in one task."""
    dealt = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(max(64, cut.count() // SHARE))).cast("int"))
    sums = Window.partitionBy("length").orderBy("share")
    before = written(dealt.groupBy("length", "share").agg(F.count("*").alias("n")).select("length", "share", (F.sum("n").over(sums) - F.col("n")).alias("before")), "spfhp-shares")
    own = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")
    joined = join_small(dealt.withColumn("own", F.row_number().over(own) - 1), before, ["length", "share"], "inner")
    return joined.withColumn("rank", (F.col("before") + F.col("own")).cast("long"))


def aside(docs: DataFrame, plan: Plan, share: int, total: int, path: str) -> DataFrame:
    """Pieces of the documents set aside, in the run that fills the gaps."""
    importable(docs.sparkSession)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py(), path)
                rows.append((doc_id, task, before, len(ids), ids.tobytes()))
                before += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "task", "before", "tokens", "ids"])

    # written: which document stands where in a task's run is settled once
    run = written(slim(docs).where(part() < share).select("doc_id", "text").mapInArrow(tokens, "doc_id long, task int, before long, tokens long, ids binary"), "spfhp-run")
    # a row per task that had any
    tasks = run.groupBy("task").agg(F.sum("tokens").alias("n")).select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("first"))
    placed = join_small(run, written(tasks, "spfhp-tasks"), "task", "inner").select("doc_id", (F.col("first") + F.col("before")).alias("first"), "tokens", "ids")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, first, n, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
            out += [(doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, offset) for start, length, sequence, offset in plan.runs(first, n, total)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [c.split()[0] for c in PLACED.split(", ")])

    return mapped(placed, rows, PLACED)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    path = path or tokenizer_path()
    cut = written(pieces(docs, capacity, path), "spfhp-pieces")
    plan, share, total = planned(cut, capacity)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = plan.places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    whole = mapped(ranked(cut.where(F.col("part") >= share)).select(*names, "rank"), rows, PLACED)
    return whole.unionByName(aside(docs, plan, share, total, path)) if share else whole
