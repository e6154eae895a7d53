"""Pictures as tables: sizes, and how much ink a page or cover has."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.session import importable

#: Fixed value: an image's longest side, beyond which it is made smaller.
LONGEST = 1600
#: What a thumbnail must show to be told on a shelf.
LEAST_CONTRAST, LEAST_INK, MOST_OFF_CENTRE, MOST_CORNER_SPREAD = 0.9, 0.03, 8, 0.02
INK = "name string, width int, height int, least double, most double, mean double, ink double, corner_spread double, left int, top int, right int, bottom int"


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(name, width, height, channels, data): pictures of a folder, as the image source reads them."""
    found = spark.read.format("image").option("dropInvalid", "true").load(folder)
    return found.select(F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("name"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def ink_of(width: int, height: int, channels: int, data: bytes) -> tuple:
    """Brightness and ink of one picture: ink is what is over a tenth darker or lighter than the ground, its corners."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float) / 255
    # blue, green, red is the source's order
    grey = pixels[..., 0] if channels < 3 else pixels[..., :3] @ np.array([0.0722, 0.7152, 0.2126])
    corners = np.array([grey[0, 0], grey[0, -1], grey[-1, 0], grey[-1, -1]])
    marked = np.abs(grey - np.median(corners)) > 0.1
    rows, cols = np.flatnonzero(marked.any(1)), np.flatnonzero(marked.any(0))
    box = (int(cols[0]), int(rows[0]), int(cols[-1]), int(rows[-1])) if len(rows) else (None,) * 4
    return (float(grey.min()), float(grey.max()), float(grey.mean()), float(marked.mean()), float(corners.max() - corners.min()), *box)


def ink(pictures: DataFrame) -> DataFrame:
    """INK of pictures(name, width, height, channels, data)."""
    importable(pictures.sparkSession)
    kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 5, *[pa.int32()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, w, h, *ink_of(w, h, c, d)) for n, w, h, c, d in zip(*(x.to_pylist() for x in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in INK.split(", ")])

    return pictures.where("width > 0 and height > 0").select("name", "width", "height", "channels", "data").mapInArrow(run, INK)


def shelf_verdicts(inked: DataFrame) -> DataFrame:
    """(name, error): what a cover's thumbnail lacks; no row if it is fine."""
    centre = (F.col("left") + F.col("right") + 1 - F.col("width")) / 2
    checks = F.array(
        F.when(F.col("most") - F.col("least") <= LEAST_CONTRAST, "too little contrast"),
        F.when(F.col("ink") <= LEAST_INK, "too little ink"),
        F.when(F.abs(centre) > MOST_OFF_CENTRE, "off centre"),
        F.when(F.col("corner_spread") >= MOST_CORNER_SPREAD, "uneven corners"),
    )
    return inked.select("name", F.explode(checks).alias("error")).where("error is not null")


def resize_plan(pictures: DataFrame, longest: int = LONGEST) -> DataFrame:
    """pictures(name, width, height, …) with the size they should be given: the longest side capped, never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest("width", "height"))
    return pictures.withColumn("new_width", F.greatest(F.round(F.col("width") * scale), F.lit(1)).cast("int")).withColumn("new_height", F.greatest(F.round(F.col("height") * scale), F.lit(1)).cast("int"))


# ---- pictures made smaller

#: Colours of a palette, and bits of a channel by which colours are told apart where there are more.
COLOURS, BITS = 256, 5
SMALLER = "name string, content binary, original_size long, new_size long"


def png(width: int, height: int, kind: int, depth: int, rows: np.ndarray, chunks: list[tuple[bytes, bytes]] = [], level: int = 9) -> bytes:  # noqa: B006
    """A PNG of rows of bytes, unfiltered; kind and depth are those of its header."""
    data = zlib.compress(np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)
    parts = [(b"IHDR", head), *chunks, (b"IDAT", data), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(x)) + t + x + struct.pack(">I", zlib.crc32(t + x)) for t, x in parts)


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels (height, width, channels) as fewer, each the mean of the area that it covers."""

    def along(values: np.ndarray, n: int) -> np.ndarray:
        """The first axis as n means: differences of running sums at the edges, which may be within a pixel."""
        size = len(values)
        sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0)])
        edges = np.linspace(0, size, n + 1)
        whole = np.minimum(edges.astype(int), size - 1)
        part = (edges - whole).reshape(-1, *[1] * (values.ndim - 1))
        return np.diff(sums[whole] + part * values[whole], axis=0) * (n / size)

    out = pixels.astype(float)
    if height < len(pixels):
        out = along(out, height)
    if width < pixels.shape[1]:
        out = along(out.swapaxes(0, 1), width).swapaxes(0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def palette_of(colours: np.ndarray, counts: np.ndarray, most: int = COLOURS) -> np.ndarray:
    """Which of at most `most` boxes each colour falls in: boxes are cut at their median, the one that would gain most first."""
    box = np.zeros(len(colours), int)
    values, weights = colours.astype(float), counts.astype(float)

    def gain(at: np.ndarray) -> tuple[float, int]:
        """Spread along the widest channel, by weight; and which that is."""
        mean = np.average(values[at], axis=0, weights=weights[at])
        spread = (weights[at, None] * (values[at] - mean) ** 2).sum(0)
        return float(spread.max()), int(spread.argmax())

    everything = np.arange(len(colours))
    heap = [(-gain(everything)[0], 0, everything)]
    n = 1
    while n < min(most, len(colours)) and heap and heap[0][0] < 0:
        _, number, at = heapq.heappop(heap)
        channel = gain(at)[1]
        at = at[np.argsort(values[at, channel], kind="stable")]
        below = np.cumsum(weights[at])
        cut = int(np.clip(np.searchsorted(below, below[-1] / 2) + 1, 1, len(at) - 1))
        for own, part in ((number, at[:cut]), (n, at[cut:])):
            box[part] = own
            if len(part) > 1:
                heapq.heappush(heap, (-gain(part)[0], own, part))
        n += 1
    return box


def in_palette(pixels: np.ndarray) -> bytes:
    """Pixels (height, width, 1, 3 or 4 channels; red first) as a PNG with a palette, exact if there are few enough colours."""
    height, width, channels = pixels.shape
    flat = pixels.reshape(-1, channels)
    flat = np.repeat(flat, 3, 1) if channels == 1 else flat
    if channels == 4:
        flat = np.where(flat[:, 3:] == 0, 0, flat)  # what can't be seen has one colour
    colours, index, counts = np.unique(flat, axis=0, return_inverse=True, return_counts=True)
    index = index.ravel()
    if len(colours) > COLOURS:
        cells, cell = np.unique(colours >> (8 - BITS), axis=0, return_inverse=True)
        cell = cell.ravel()
        weight = np.bincount(cell, counts)
        mean = np.stack([np.bincount(cell, counts * colours[:, c]) / weight for c in range(colours.shape[1])], 1)
        box = palette_of(mean, weight)[cell]
        total = np.bincount(box, counts)
        colours = np.rint(np.stack([np.bincount(box, counts * colours[:, c]) / total for c in range(colours.shape[1])], 1)).astype(np.uint8)
        index = box[index]
    chunks = [(b"PLTE", np.ascontiguousarray(colours[:, :3]).tobytes())]
    if channels == 4 and (colours[:, 3] < 255).any():
        chunks.append((b"tRNS", np.ascontiguousarray(colours[:, 3]).tobytes()))
    depth = next(d for d in (1, 2, 4, 8) if len(colours) <= 1 << d)
    rows = index.reshape(height, width).astype(np.uint8)
    if depth < 8:
        each = 8 // depth
        rows = np.pad(rows, ((0, 0), (0, -width % each))).reshape(height, -1, each)
        rows = (rows << (np.arange(each)[::-1] * depth).astype(np.uint8)).sum(2).astype(np.uint8)
    return png(width, height, 3, depth, rows, chunks)


def smaller(spark: SparkSession, folder: str, longest: int = LONGEST) -> DataFrame:
    """SMALLER of all files of a folder: PNGs with sides of `longest` at most and a palette, where that takes fewer bytes.

    What doesn't, isn't a PNG or can't be read keeps its own bytes, and its new_size is null. (JPEGs would need an encoder of their own.)"""
    importable(spark)
    own = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content", F.col("length").alias("original_size"))
    plan = resize_plan(decoded(spark, folder), longest).select(F.col("name").alias("read_name"), "width", "height", "channels", "data", "new_width", "new_height")
    is_png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    joined = own.join(plan, is_png & (F.col("name") == F.col("read_name")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content, size, width, height, channels, data, new_width, new_height in zip(*(c.to_pylist() for c in batch.columns)):
                new = None
                if data is not None:
                    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                    order = [2, 1, 0, 3][:channels] if channels > 1 else [0]  # blue comes first in what was read
                    new = in_palette(scaled(pixels[..., order], new_width, new_height))
                shrunk = new is not None and len(new) < size
                rows.append((name, new if shrunk else content, size, len(new) if shrunk else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64(), pa.int64()))], [c.split()[0] for c in SMALLER.split(", ")])

    return joined.select("name", "content", "original_size", "width", "height", "channels", "data", "new_width", "new_height").mapInArrow(run, SMALLER)
