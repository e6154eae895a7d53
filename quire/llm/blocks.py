"""Counting hashed keys over a corpus, block by block.

Documents are written to the shared folder as blocks of some megabytes of text. A
block asks about the distinct keys (unsigned 64-bit hashes) that occur in it, with its
own counts: sorted, and split by their leading bits into buckets. A bucket adds up
what all blocks say of its keys, and answers each block in the order of its keys. So
a key crosses the network once per block that has it, whatever its frequency, and a
bucket holds a bounded share of all distinct keys: the number of buckets follows the
number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, packed_ints, unpacked, unpacked_ints, written

#: A block's texts have about so many characters, or are one document.
CHARACTERS = 8_000_000
ASK = "bucket long, block long, keys binary, counts binary"


def framed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unframed(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def documents_of(payload: bytes) -> tuple[list[int | None], list[str]]:
    """Ids and texts of a block; null texts are empty."""
    found = unframed(payload)
    return found["doc_id"].to_pylist(), [t or "" for t in found["text"].to_pylist()]


def blocks(docs: DataFrame, name: str, characters: int = CHARACTERS) -> DataFrame:
    """(block, payload), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # unique, and no more than a name: what is written decides
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal held, size, number
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([framed(whole)], pa.binary())], ["block", "payload"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for k, n in enumerate(lengths):
                size += int(n)
                if size >= characters:
                    held.append(batch.slice(start, k + 1 - start))
                    start = k + 1
                    yield block()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield block()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(slim.mapInArrow(run, "block long, payload binary"), name)


def dealt(rows: DataFrame, key: str, number_of_blocks: int) -> DataFrame:
    """Rows in partitions by bucket or block, as many as hold the keys of some blocks each, however many there are."""
    return rows.repartition(max(8, number_of_blocks // 4), key)


def bucket_bits(number_of_blocks: int) -> int:
    """Enough buckets for any number of partitions, and for each to hold about two blocks' keys."""
    return max(9, (max(1, number_of_blocks) // 2).bit_length())


def asked(block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> list[tuple[int, int, bytes, bytes]]:
    """Rows of ASK for sorted distinct keys."""
    heads = (keys >> np.uint64(64 - bits)).astype(np.int64)
    found, starts = np.unique(heads, return_index=True)
    stops = np.append(starts[1:], len(keys))
    return [(int(b), block, packed(keys[i:j]), packed_ints(counts[i:j])) for b, i, j in zip(found, starts, stops)]


def ask_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "keys", "counts"])


def answered(bucket: pa.Table, first: bool = False) -> pa.Table:
    """Totals of one bucket's keys for each of its blocks; with first, 0 for a total of one,
    else 1, or 2 in the block of the least number that has the key. Blocks of negative
    numbers are counted, but not answered."""
    bucket = bucket.take(pc.sort_indices(pc.if_else(pc.less(bucket["block"], 0), pa.scalar(2**62, pa.int64()), bucket["block"])))
    keys = [unpacked(x) for x in bucket["keys"].to_pylist()]
    counts = [unpacked_ints(x) for x in bucket["counts"].to_pylist()]
    _, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
    told = totals[inverse]
    if first:
        told = (told > 1).astype(np.int64)
        told[at] *= 2
    stops = np.cumsum([len(k) for k in keys])
    out = pa.table({"bucket": bucket["bucket"], "block": bucket["block"], "keys": pa.nulls(len(keys), pa.binary()), "counts": pa.array([packed_ints(told[j - len(k) : j]) for k, j in zip(keys, stops)], pa.binary())})
    return out.filter(pc.greater_equal(out["block"], 0))


def told(answers: pa.Table) -> np.ndarray:
    """A block's answers in the order of its keys."""
    answers = answers.sort_by("bucket")
    found = [unpacked_ints(x) for x in answers["counts"].to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, np.int64)
