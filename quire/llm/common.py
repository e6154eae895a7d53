"""What the operators of this subpackage share: size-checked joins and small array codecs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.session import importable, own_dir, written

__all__ = ["importable", "join_small", "mapped", "mix64", "own_dir", "packed", "packed_ints", "table", "unpacked", "unpacked_ints", "unused", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\v\f\r"
#: A side of a join is broadcast only when it was counted to be no larger.
BROADCAST_ROWS = 20_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with a written table that is normally small: broadcast if its counted
    rows are few, else an ordinary join whose hot keys adaptive execution splits."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow with a function on single batches."""

    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def unused(name: str, df: DataFrame) -> str:
    """name, lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as compressed byte planes of their differences."""
    import zstandard

    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def packed_ints(values: np.ndarray) -> bytes:
    """Small non-negative integers in any order."""
    import zstandard

    width = "<u1" if not len(values) or values.max() < 256 else "<u4" if values.max() < 2**32 else "<u8"
    return width.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype(width).tobytes())


def unpacked_ints(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[3:]), blob[:3].decode()).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
