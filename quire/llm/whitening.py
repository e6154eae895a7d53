"""Whitening of embeddings by an exact integer scatter.

Components become whole numbers x = floor(scale * c). The fit is over the distinct
vectors, each once. A task subtracts a shift of its own (the rounded mean of the first
vectors it sees), which keeps numbers small, and adds up sums and cross-products of what
is left without any rounding: a product of two matrices of doubles is exact as long as
no entry can pass 2^53, so vectors are cut into limbs small enough for that, and the
products of limbs are added as whole numbers of any size. The shift is put back exactly.
Tasks give their totals as limbs of 31 bits, by which Spark adds them, entry by entry.

From n, S and X'X the scatter n X'X - S S' is formed exactly. Only then it is divided by
n^2, rounded once, and decomposed by eigh; these matrices are as large as the vectors
are long, whatever the number of rows. Each component's largest entry is positive.

Null vectors, and those with null or non-finite components, take no part. Vectors of
different lengths have a fit for each length. Components of a vector whose scaled value
passes a long are cut to it. Rows are all kept, repeated ids and null ids too. A vector
has a row for each of its first `components` components; where the eigenvalue is 0 but
for rounding, nothing can be whitened and `whitened` is null, and `explained` is null
where all eigenvalues are. A deviation that passes a long is null. Empty vectors have no
components and so no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, mapped, written

SCALE = 256
COMPONENTS = 4
#: Bits of a limb of vectors, and vectors multiplied at once: 2 * LIMB + log2(ROWS) < 53.
LIMB, ROWS = 20, 4_096
#: Bits of a limb of totals: 2^32 tasks can be added in a long.
TOTAL = 31
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, width, x) of the vectors that take part."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    edge = float(2**63 - 1024)  # the largest double within a long
    x = lambda c: F.greatest(F.least(F.floor(c * scale).cast("double"), F.lit(edge)), F.lit(-edge)).cast("long")
    exact = lambda c: F.when(F.abs(c * scale) < 2.0**52, F.floor(c * scale).cast("long")).otherwise(x(c))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    found = found.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    return found.select("vec_id", F.size("v").alias("width"), F.transform("v", exact).alias("x"))


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles p with x = sum of p[k] * 2^(LIMB * k); the last carries the sign."""
    out = []
    while len(x) and (x.max() >= 1 << LIMB or x.min() < -(1 << LIMB)):
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB
    return [*out, x.astype(float)]


def exact_products(x: np.ndarray) -> np.ndarray:
    """x'x of a matrix of longs, as whole numbers of any size."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
                total += product if i == j else product + product.T
    return total


class Scatter:
    """n, S and X'X of the vectors seen so far, exactly."""

    def __init__(self, width: int) -> None:
        self.n, self.shift = 0, None
        self.sums, self.products = np.zeros(width, object), np.zeros((width, width), object)

    def add(self, x: np.ndarray) -> None:
        if self.shift is None:
            self.shift = np.clip(np.rint(x.mean(0)), -(2.0**61), 2.0**61).astype(np.int64)
        far = max(abs(int(x.max())), abs(int(x.min()))) >= 2**61  # the difference could pass a long
        shift = np.zeros_like(self.shift) if far else self.shift
        y, s = x - shift, shift.astype(object)
        sums = sum((y[at : at + ROWS] >> 32).sum(0).astype(object) * 2**32 + (y[at : at + ROWS] & 0xFFFFFFFF).sum(0).astype(object) for at in range(0, len(y), ROWS))
        cross = np.outer(s, sums)
        self.n += len(y)
        self.sums += sums + len(y) * s
        self.products += exact_products(y) + cross + cross.T + len(y) * np.outer(s, s)

    def entries(self, width: int) -> list[tuple[int, int, int, int, int]]:
        """(width, i, j, limb, value): the products, the sums (j = -1) and n (i = j = -1) in limbs that carry their number's sign."""
        out = []
        for i, j, v in [(-1, -1, self.n), *((i, -1, v) for i, v in enumerate(self.sums)), *((i, j, self.products[i, j]) for i in range(width) for j in range(i + 1))]:
            sign, v, k = (-1 if v < 0 else 1), abs(int(v)), 0
            while v:
                out.append((width, i, j, k, sign * (v & ((1 << TOTAL) - 1))))
                v, k = v >> TOTAL, k + 1
        return out


def matrix(values: pa.Array) -> np.ndarray:
    """Lists of one length, as the rows of a matrix."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(values), -1)


def scatter(fit: DataFrame) -> DataFrame:
    """(width, i, j, limb, value) of distinct vectors (width, x), added up over all tasks."""
    importable(fit.sparkSession)
    names = ["width", "i", "j", "limb", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Scatter] = {}
        for batch in batches:
            for width, part in by_width(batch):
                found.setdefault(width, Scatter(width)).add(matrix(part.column("x")))
        for width, one in found.items():
            rows = one.entries(width)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    parts = fit.select("width", "x").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return parts.groupBy("width", "i", "j", "limb").agg(F.sum("value").alias("value"))


def assembled(found: pa.Table, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, S and n X'X - S S' of one width."""
    n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
    for i, j, k, v in zip(*(found[c].to_pylist() for c in ("i", "j", "limb", "value"))):
        v <<= TOTAL * k
        if i < 0:
            n += v
        elif j < 0:
            sums[i] += v
        else:
            products[i, j] += v
            if i != j:
                products[j, i] += v
    return n, sums, n * products - np.outer(sums, sums)


def decomposed(n: int, scattered: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues (falling), their unit eigenvectors as rows, and the trace of the covariance."""
    covariance = np.array([[int(v) / n**2 for v in row] for row in scattered], float)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    top = np.abs(vectors).argmax(1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), top])[:, None]
    trace = sum(int(scattered[i, i]) for i in range(len(scattered))) / n**2
    return np.where(values > trace * len(covariance) * 1e-14, values, 0.0), vectors, trace


class Model:
    """The fit of one length of vectors."""

    def __init__(self, found: pa.Table, width: int, components: int) -> None:
        self.n, self.sums, scattered = assembled(found, width)
        self.values, self.axes, trace = decomposed(self.n, scattered, components)
        self.explained = [v / trace if trace else None for v in self.values.tolist()]
        self.largest = max(abs(int(v)) for v in self.sums)
        self.error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        most = max(abs(int(x.max())), abs(int(x.min())))
        if self.n * most + self.largest < 2**63:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whitened(self, centred: np.ndarray) -> list[list[float | None]]:
        """Whole numbers are divided by n, rounded once, and only then projected."""
        got = (centred / self.n).astype(float) @ self.axes.T / np.sqrt(np.where(self.values > 0, self.values, 1))
        got = got.astype(object)
        got[:, self.values <= 0] = None
        return got.tolist()


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly; null beyond a long."""
    most = max(abs(int(centred.max())), abs(int(centred.min())))
    if most**2 * centred.shape[1] < 2**63:
        return (centred.astype(np.int64) ** 2).sum(1).tolist()
    return [v if v < 2**63 else None for v in (centred.astype(object) ** 2).sum(1)]


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        yield width, batch.filter(pa.array(widths == width))


def fit_list(rows: DataFrame) -> DataFrame:
    """(width, x): each distinct x once, written. Copies are partial groups: a vector that a third of all rows share is one row per task."""
    return written(rows.groupBy("x").agg(F.first("width").alias("width")).select("width", "x"), "whitening-fit")


def models(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """By width. What comes to the driver is as large as the square of a vector's length, for each length there is."""
    found = scatter(fit).toArrow()
    out = {}
    for width in sorted(set(found["width"].to_pylist())):
        out[width] = Model(found.filter(pa.array(found["width"].to_numpy() == width)), width, components)
    names = [f"w{k}" for k in range(components)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(width, *w, *[None] * (components - len(w))) for width, part in by_width(batch) for w in out[width].whitened(out[width].centred(matrix(part.column("x"))))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k else pa.int32()) for k, c in enumerate(zip(*rows))], ["width", *names])

    # covariances of Spark's own aggregate, which is centred
    pairs = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    wide = mapped(fit, run, "width int, " + ", ".join(f"{c} double" for c in names))
    for r in wide.groupBy("width").agg(*(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).collect():
        off = [abs(r[f"{a}_{b}"] - (a == b)) for a, b in pairs if r[f"{a}_{b}"] is not None]
        out[r["width"]].error = max(off, default=None)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = whole(vectors, scale)
    fitted = models(fit_list(rows), components)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for width, part in by_width(batch):
            m = fitted[width]
            centred = m.centred(matrix(part.column("x")))
            for vec_id, deviation, w in zip(part.column("vec_id").to_pylist(), deviations(centred), m.whitened(centred)):
                out += [(vec_id, k + 1, m.n, deviation, v, m.explained[k], m.error) for k, v in enumerate(w)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], [f.split()[0] for f in RESULT.split(", ")])

    return mapped(rows, run, RESULT)


def scatter_entries(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """The exact scatter itself: (width, i, j, n, entry) with dimensions from 1 and i >= j, entry a decimal string of n X'X - S S'."""

    def tell(found: pa.Table) -> pa.Table:
        width = found["width"][0].as_py()
        n, _, scattered = assembled(found, width)
        i, j = np.tril_indices(width)
        return pa.table({"width": pa.array([width] * len(i), pa.int32()), "i": pa.array(i + 1, pa.int32()), "j": pa.array(j + 1, pa.int32()), "n": pa.array([n] * len(i), pa.int64()), "entry": [str(v) for v in scattered[i, j]]})

    return scatter(fit_list(whole(vectors, scale))).groupBy("width").applyInArrow(tell, "width int, i int, j int, n long, entry string")
