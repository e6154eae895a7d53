"""SimHash near-duplicates by exact tiled comparison.

Each document has a 64-bit fingerprint of its three-word shingles. Equal
fingerprints are one class, so only distinct ones are compared: they are laid in
tiles of one population count each, and two tiles are compared, with numpy's
exclusive-or and bit counts, unless their population counts differ by more than
the radius (then no pair of them can be within it). A tile pair returns a spanning
forest of its links, one row per linked fingerprint, never all pairs of a group.
Components are found over those rows by passing least labels along links and along
labels, in written rounds.

All distinct fingerprints are compared with all others of near population counts,
so the work grows with their square; a tile, not a table, is what a task holds.

Nulls and texts without words have fingerprint zero, which links like any other.
A null doc_id is kept, and counts as the largest in a component; where a component
has no other, its id is null. Repeated rows are returned each. Columns beyond
doc_id and text are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, unused, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a tile, about.
TILE = 16_384
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned; a bit is set if more than half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(shingle)))]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], "<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print), the fingerprint as a signed long."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows, "doc_id long, print long")


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; root holds each node's least known one, flat."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints and their representatives, within left (right None) or between both."""
    both = left if right is None else np.concatenate([left, right])
    root, shift = np.arange(len(both)), 0 if right is None else len(left)
    other = left if right is None else right
    step = max(1, (1 << 21) // max(1, len(other)))
    for at in range(0, len(left), step):
        behind = at if right is None else 0
        i, j = np.nonzero(np.bitwise_count(left[at : at + step, None] ^ other[None, behind:]) <= radius)
        if right is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            merge(root, i + at, j + behind + shift)
    linked = np.flatnonzero(root != np.arange(len(both)))
    return both[linked], both[root[linked]]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column print) that connect all that is within the radius."""
    spark = prints.sparkSession
    classes = {r["ones"]: max(1, -(-r["n"] // tile)) for r in prints.groupBy(F.bit_count("print").alias("ones")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    parts = F.create_map(*(F.lit(x) for kv in classes.items() for x in kv)) if classes else F.create_map(F.lit(0), F.lit(1))
    tiled = prints.select("print", F.bit_count("print").alias("ones")).withColumn("part", F.pmod(F.xxhash64("print"), parts[F.col("ones")]).cast("int"))
    tiles = written(tiled.groupBy("ones", "part").agg(F.collect_list("print").alias("prints")), "simhash-tiles")
    here = spark.createDataFrame([(ones, near, n) for ones in classes for near, n in classes.items() if ones <= near <= ones + radius] or [(0, 0, 0)], "ones int, ones2 int, parts2 int")  # 65 x (radius + 1) rows at most
    pairs = tiles.select("ones", "part").join(F.broadcast(here), "ones").where("parts2 > 0").withColumn("part2", F.explode(F.expr("sequence(0, parts2 - 1)")))
    pairs = pairs.where("ones < ones2 or part <= part2").select("ones", "part", "ones2", "part2")
    right = tiles.select(F.col("ones").alias("ones2"), F.col("part").alias("part2"), F.col("prints").alias("prints2"))
    n = max(8, sum(classes.values()) * (radius + 1))
    sides = pairs.join(tiles, ["ones", "part"]).join(right, ["ones2", "part2"]).repartition(n, "ones", "part", "ones2", "part2")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for k in range(batch.num_rows):
            values = [batch.column(c)[k].as_py() for c in range(4)]
            a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (4, 5))
            found.append(forest(a, None if values[:2] == values[2:] else b, radius))
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return mapped(sides.select("ones", "part", "ones2", "part2", "prints", "prints2"), rows, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b): root is the component's least node."""
    both = written(edges.union(edges.select("b", "a")).distinct(), "simhash-edges")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "simhash-roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jumped = least.join(roots.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", "was", F.least("root", "far").alias("root"))
        now = written(jumped, "simhash-roots")
        if now.where("root <> was").isEmpty():
            return now.select("node", "root")
        roots = now.select("node", "root")


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    found = written(fingerprints(docs, shingle), "simhash-prints")
    own = written(found.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(written(links(own.select("print"), radius, tile), "simhash-links"))
    rooted = own.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return found.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """docs without near copies: of each component the row with the least doc_id stays (nulls last; of repeated rows, one)."""
    row, id_, print_ = (unused(x, docs) for x in ("row", "doc_id__", "print"))

    at = docs.columns.index("text")
    from pyspark.sql import types as T

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], [*batch.schema.names, print_])

    kept = written(mapped(docs, rows, T.StructType([*docs.schema.fields, T.StructField(print_, T.LongType())])), "simhash-documents")
    # of a fingerprint's rows the least doc_id stays, and of equal doc_ids the row with the least hash of all its columns
    keyed = kept.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), row: F.xxhash64(*docs.columns)})
    own = written(keyed.groupBy(F.col(print_).alias("print")).agg(F.min(F.struct(F.col(id_).alias("id"), F.col(row).alias("row"))).alias("best")), "simhash-distinct")
    roots = components(written(links(own.select("print"), radius, tile), "simhash-links"))
    rooted = own.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    chosen = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.id").alias(id_), F.col("best.row").alias(row))
    first = keyed.join(chosen, [id_, row])
    # exact repeats of the chosen row share its key: one of them stays
    return first.dropDuplicates([id_, row]).select(*docs.columns)
