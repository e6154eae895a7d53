"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vector components are floored to whole impacts. Vectors are dealt into blocks. A block's
postings (row, impact) are kept by segment: one dimension and one quantised impact, the
half octave of its size. Segments are taken by descending quantised impact, by all
queries of a block together, and add to the accumulators of the rows they list, and of
no others. After each level of impacts, what a row can still get is bounded by the
lengths of what is left of its vector and of the query in the dimensions where the row
hasn't been met (the inner product of two vectors is at most the product of their
lengths). The exact scores of some leaders give a threshold, and a query stops only when
the rows whose bound reaches it are few enough to be rescored exactly, ties included;
otherwise it goes on to the next level, and after the last every score is exact. Blocks
answer with their k best; the k best of those are the result.

Queries are a stated set. They come in passes of bounded size, each of which is sent to
every index block, so no table but a pass's queries is ever held whole, and no pass has
more tasks than the index has blocks (or a few, if it is small). Nothing is approximate,
and no candidate is dropped without proof.

Null vectors and those holding null or non-finite components take no part. Rows are
told apart by a number of their own: a row is never its own candidate, rows that repeat
its id are, and an id that several rows have is a query in each of them, with a result
(ranks from 1) each. Vectors of unequal lengths meet in the dimensions both have, the
others being zero; empty ones score 0. Equal scores go to the smaller id. Scores beyond
a long are cut to it. A null id takes no part. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_small, mapped, own_dir, written

K = 5
SCALE = 256
EVERY = 50
#: Vectors of an index block, queries of a query block, and queries that accumulate together.
BLOCK, QUERIES, TOGETHER = 8_192, 512, 64
#: Components of the queries of a pass, which are broadcast (8 MB), and tasks that a pass has where the index has few blocks.
ASKED, TASKS = 1 << 20, 32
#: A query stops when so small a part of a block could still be in its result.
FEW = 1 / 64
#: Bounds are looked at when this part of the postings is taken, and after each level from then on.
LOOK = 1 / 4
#: Below any score.
NONE = -(2.0**62)


def impacts(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, width, impacts) of the vectors that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    found = found.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return found.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("width"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("impacts"))


def blocked(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(block, width, rows, ids, data): vectors of one length side by side, blocks numbered from 0; and how many there are."""
    widths = rows.groupBy("width").agg(F.ceil(F.count("*") / size).alias("own"))
    # one row per length of vectors: a handful
    widths = written(widths.withColumn("first", F.sum("own").over(Window.orderBy("width")) - F.col("own")), f"{name}-widths")
    dealt = join_small(rows, widths, "width").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("own")))
    found = dealt.groupBy("block", "width").agg(F.collect_list(F.struct("row", "vec_id", "impacts")).alias("all"))
    return written(found.select("block", "width", F.col("all.row").alias("rows"), F.col("all.vec_id").alias("ids"), F.flatten("all.impacts").alias("data")), name), widths.agg(F.sum("own")).collect()[0][0] or 0


class Index:
    """The postings of a block by segment, in the order in which they are taken."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        size = np.abs(data)
        level = np.zeros(data.shape, np.int64)
        np.floor(2 * np.log2(size, where=size > 0, out=np.zeros(data.shape)), out=level, where=size > 0, casting="unsafe")
        level += size > 0
        row, dimension = np.nonzero(data)
        own = level[row, dimension]
        order = np.lexsort((row, dimension, -own))
        row, dimension, own = row[order], dimension[order], own[order]
        cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(dimension) != 0)) + 1
        starts, ends = np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(row)]]).tolist()
        impact = data[row, dimension]
        #: per level: (dimension, rows, impacts) of its segments
        self.levels: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for k, (a, b) in enumerate(zip(starts, ends)):
            if a == b:
                continue
            if not k or own[a] != own[a - 1]:
                self.levels.append([])
            self.levels[-1].append((int(dimension[a]), row[a:b], impact[a:b].astype(float)))
        self.postings = len(row)
        self.energy = (data.astype(float) ** 2).sum(1)


def best(ids: np.ndarray, data: np.ndarray, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best of these rows."""
    exact = data[rows] @ query
    order = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows][order], exact[order]


def search_block(rows: np.ndarray, ids: np.ndarray, index: Index, query_rows: np.ndarray, queries: np.ndarray, k: int, few: float = FEW) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Per query, ids and scores of its k best in the block; and how many products were made."""
    data, n = index.data, len(ids)
    found: list = [None] * len(query_rows)
    products = 0
    q = queries.astype(float)
    score = np.zeros((n, len(q)))
    met = np.zeros((n, len(q)))  # squares of the query's components in the dimensions met
    own = np.searchsorted(rows, query_rows)
    own[(own < n) & (rows[np.minimum(own, n - 1)] != query_rows)] = n
    score[own[own < n], np.flatnonzero(own < n)] = NONE
    left, whole = index.energy.copy(), (q**2).sum(1)
    open_ = np.arange(len(q))
    taken = 0
    groups = min(n, max(16 * k, 64))
    for level in [*index.levels, None]:
        for dimension, at, impact in level or []:
            here = q[:, dimension]
            score[at] += impact[:, None] * here
            met[at] += here**2
            left[at] -= impact**2
            taken += len(at)
            products += len(at) * len(q)
        last = level is None or taken == index.postings
        if not last and taken < LOOK * index.postings:
            continue
        if last:
            threshold = np.full(len(q), NONE)
            if n > k:
                threshold = np.maximum(np.partition(score, n - k, axis=0)[n - k], NONE)
            could = (score >= threshold) & (score > NONE / 2)
        else:
            # one leader of each of some groups of rows
            edges = np.linspace(0, n, groups, endpoint=False).astype(int)
            leaders = np.stack([a + score[a:b].argmax(0) for a, b in zip(edges, [*edges[1:], n])])
            exact = np.einsum("lqd,qd->lq", data[leaders].astype(float), q)
            exact[np.take_along_axis(score, leaders, 0) < NONE / 2] = NONE
            products += exact.size * data.shape[1]
            threshold = np.partition(exact, groups - k, axis=0)[groups - k] if groups > k else np.full(len(q), NONE)
            # a whole unit for the rounding of roots
            could = (score + np.sqrt(np.maximum(left, 0)[:, None] * np.maximum(whole - met, 0)) + 1 >= threshold) & (score > NONE / 2)
        stop = np.full(len(q), True) if last else could.sum(0) <= max(4 * k, n * few)
        for c in np.flatnonzero(stop):
            possible = np.flatnonzero(could[:, c])
            found[open_[c]] = best(ids, data, possible, queries[open_[c]], k)
            products += len(possible) * data.shape[1]
        if stop.all():
            break
        if stop.any():
            open_, q, whole, score, met = open_[~stop], q[~stop], whole[~stop], np.ascontiguousarray(score[:, ~stop]), np.ascontiguousarray(met[:, ~stop])
    return found, products


def too_large(data: np.ndarray, queries: np.ndarray) -> bool:
    """Whether sums of products may not be whole in doubles."""
    a, b = (float(np.abs(x.astype(float)).max(initial=0)) for x in (data, queries))
    return max(a, b) ** 2 * max(1, data.shape[1]) >= 2**52


def plain(rows: np.ndarray, ids: np.ndarray, data: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same in whole numbers of any size."""
    out = []
    for row, query in zip(query_rows, queries.astype(object)):
        scores = [max(-(2**63), min(2**63 - 1, int(x @ query))) for x in data.astype(object)]
        order = sorted((i for i in range(len(ids)) if rows[i] != row), key=lambda i: (-scores[i], ids[i]))[:k]
        out.append((ids[order], np.array([scores[i] for i in order], np.int64)))
    return out


def passes(query_blocks: int, width: int, asked: int | None = None) -> list[range]:
    """Numbers of query blocks that go together: as many as have no more than `asked` components, one at least."""
    step = max(1, (asked or ASKED) // (QUERIES * max(1, width)))
    return [range(a, min(a + step, query_blocks)) for a in range(0, query_blocks, step)]


def search(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = written(impacts(vectors, scale), "topk-impacts")
    index, index_blocks = blocked(rows, block, "topk-index")
    queries, query_blocks = blocked(rows.where(F.col("vec_id") % every == 0), QUERIES, "topk-queries")
    width = rows.agg(F.max("width")).collect()[0][0] or 0

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[np.ndarray, ...]] = []
        whole = lambda x: x.values.to_numpy(zero_copy_only=False).astype(np.int64)
        for r in range(batch.num_rows):
            own, ids, data = (whole(batch.column(c)[r]) for c in range(3))
            order = np.argsort(own)
            own, ids, data = own[order], ids[order], data.reshape(len(ids), -1)[order]
            postings: dict[int, Index] = {}
            for asked in batch.column(3)[r]:
                query_rows, query_ids, query_data = (whole(asked[c]) for c in ("rows", "ids", "data"))
                width = min(len(query_data) // len(query_ids), data.shape[1])
                here, queries = data[:, :width], query_data.reshape(len(query_ids), -1)[:, :width]
                if too_large(here, queries):
                    found = plain(own, ids, here, query_rows, queries, k)
                else:
                    if width not in postings:
                        postings[width] = Index(here)
                    found = [x for at in range(0, len(queries), TOGETHER) for x in search_block(own, ids, postings[width], query_rows[at : at + TOGETHER], queries[at : at + TOGETHER], k)[0]]
                out += [(np.full(len(i), row), np.full(len(i), query_id), i, score) for row, query_id, (i, score) in zip(query_rows, query_ids, found)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["query_row", "query_id", "vec_id", "score"])

    first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    best_of = lambda found: found.withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    results = f"{own_dir(spark)}/topk-results-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(results)
    for part in passes(query_blocks, width):
        shares = min(len(part), max(1, -(-TASKS // index_blocks)))
        asked = queries.where(F.col("block").between(part[0], part[-1])).groupBy((F.col("block") % shares).alias("share")).agg(F.collect_list(F.struct("rows", "ids", "data")).alias("asked"))
        dealt = index.withColumn("share", F.explode(F.array(*(F.lit(n).cast("long") for n in range(shares))))).repartition(index_blocks * shares, "block", "share")
        met = dealt.join(F.broadcast(asked), "share").select("rows", "ids", "data", "asked")
        best_of(mapped(met, run, "query_row long, query_id long, vec_id long, score long")).write.mode("append").parquet(results)
    return spark.read.schema(schema).parquet(results)
