"""Uploads that arrive in pieces, and claims of things that can be had once, as keyed state.

A chunk is (upload_id, start, data, total, arrived): bytes from `start` on, the length that
the sender declared (null where a chunk doesn't say), and when it was received. Chunks of
an upload may come in any order, over any number of batches, and more than once. The
state of an upload is small whatever its length: which bytes were received (as runs that
grow together), its first bytes, its declared length. Contents stay in the table the
chunks were landed in; `assembled` reads them for uploads that were taken.

Each upload has exactly one outcome, which doesn't hang on the order of its chunks:

* "too large" when it declares more than `most`, or bytes beyond it came and the
  signature is right;
* "not a PDF" when its first bytes are known and aren't the signature, or it is complete
  and shorter than that;
* "accepted" when every byte it declared is there;
* "interrupted" when nothing came for `patience`: "too large" even then if bytes beyond
  `most` had come.

What comes after an outcome changes nothing. Null data are no bytes; a null upload_id is
an upload of its own. Negative starts are refused as "not a PDF".
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.sources.session import importable

# fixed value: the first bytes of a PDF
SIGNATURE = b"%PDF-"
MOST = 512 * 1024 * 1024
PATIENCE = timedelta(minutes=10)
OUTCOME = "upload_id string, outcome string, received long, total long, chunks long"
#: The key that requests are grouped by, beside their own columns.
KEY = "claimed_key"


def stateful(df: DataFrame) -> DataFrame:
    """df, in a session whose streams can hold keyed state."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    importable(df.sparkSession)
    return df


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs [start, end) that touch or overlap grow together."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        elif end > start:
            out.append((start, end))
    return out


def verdict(head: bytes, runs: list[tuple[int, int]], total: int | None, most: int, over: bool = False) -> str | None:
    """The outcome so far, if it can't change any more; over: nothing more will come."""
    if total is not None and total > most:
        return "too large"
    known = min(len(SIGNATURE), runs[0][1]) if runs and runs[0][0] <= 0 else 0
    if runs and runs[0][0] < 0 or head[:known] != SIGNATURE[:known]:
        return "not a PDF"
    beyond = bool(runs) and runs[-1][1] > most
    if beyond and (known == len(SIGNATURE) or over):
        return "too large"
    if total is not None and (total == 0 or runs and runs[0][0] == 0 and runs[0][1] >= total):
        return "accepted" if total >= len(SIGNATURE) else "not a PDF"
    return "interrupted" if over else None


class Uploads(StatefulProcessor):
    """State of an upload: its facts, and the runs of bytes that came (starts and stops)."""

    def __init__(self, most: int, patience: timedelta) -> None:
        self.most, self.patience = most, int(patience.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.upload = handle.getValueState("upload", "head binary, total long, chunks long, latest long, outcome string, starts array<long>, stops array<long>")

    def told(self, key: Any, state: tuple, runs: list[tuple[int, int]], outcome: str) -> Row:
        head, total, chunks, latest, *_ = state
        self.upload.update((head, total, chunks, latest, outcome, [], []))
        return Row(upload_id=key[0], outcome=outcome, received=sum(b - a for a, b in runs), total=total, chunks=chunks)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.upload.get() or (b"\0" * len(SIGNATURE), None, 0, 0, None, [], [])
        head, total, chunks, latest, outcome, starts, stops = state
        if outcome is not None:
            return
        head, runs = bytearray(head), list(zip(starts, stops))
        for start, size, first, said, arrived in ((r.start, r.size, r.first, r.total, r.arrived_ms) for r in rows):
            for k in range(max(start, 0), min(start + len(first or b""), len(SIGNATURE))):
                head[k] = first[k - start]
            runs.append((start, start + size))
            if said is not None:
                total = said if total is None else max(total, said)
            latest = max(latest, arrived)
            chunks += 1
            if len(runs) > 1000:
                runs = merged(runs)
        runs = merged(runs)
        state = (bytes(head), total, chunks, latest, None, [a for a, _ in runs], [b for _, b in runs])
        if (outcome := verdict(bytes(head), runs, total, self.most)) is not None:
            yield self.told(key, state, runs, outcome)
        else:
            self.upload.update(state)
            self.handle.registerTimer(latest + self.patience)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        state = self.upload.get()
        head, total, _, latest, outcome, starts, stops = state
        # earlier timers of an upload that went on tell nothing
        if outcome is None and timerValues.getCurrentWatermarkInMs() >= latest + self.patience:
            runs = list(zip(starts, stops))
            yield self.told(key, state, runs, verdict(head, runs, total, self.most, over=True))


def outcomes(chunks: DataFrame, most: int = MOST, patience: timedelta = PATIENCE) -> DataFrame:
    """(upload_id, outcome, received, total, chunks) of each upload, once, as soon as it is certain.

    `arrived` is when a chunk was received, so it doesn't go back by more than `patience`."""
    seconds = f"{int(patience.total_seconds())} seconds"
    # of the bytes only those of the signature go to the state, and of times their milliseconds
    first = F.when(F.col("start") < len(SIGNATURE), F.substring("data", 1, 2 * len(SIGNATURE)))
    slim = stateful(chunks).withWatermark("arrived", seconds).select("upload_id", F.col("start").cast("long").alias("start"), F.coalesce(F.length("data"), F.lit(0)).cast("long").alias("size"), first.alias("first"), F.col("total").cast("long").alias("total"), F.unix_millis("arrived").alias("arrived_ms"), "arrived")
    return slim.groupBy("upload_id").transformWithState(Uploads(most, patience), OUTCOME, "Append", "EventTime")


def assembled(chunks: DataFrame, accepted: DataFrame) -> DataFrame:
    """(upload_id, content) of accepted uploads out of their landed chunks: at most `most` bytes each. Where chunks overlap, the first by start has the byte."""
    taken = accepted.select(F.col("upload_id").alias("taken"))
    mine = chunks.where(F.length("data") > 0).join(taken, F.col("upload_id").eqNullSafe(F.col("taken")), "left_semi")
    parts = mine.groupBy("upload_id").agg(F.array_sort(F.collect_set(F.struct("start", "data"))).alias("parts"))

    def put(acc, part):
        kept = F.substring(part["data"], (acc["at"] - part["start"] + 1).cast("int"), F.length(part["data"]))
        new = part["start"] + F.length(part["data"]) > acc["at"]
        return F.when(new, F.struct((part["start"] + F.length(part["data"])).alias("at"), F.concat(acc["content"], kept).alias("content"))).otherwise(acc)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").cast("binary").alias("content"))
    return parts.select("upload_id", F.aggregate("parts", start, put)["content"].alias("content"))


class Claims(StatefulProcessor):
    """Who holds a key."""

    def __init__(self, order: list[str], name: str, keep: timedelta | None) -> None:
        self.order, self.name, self.keep = order, name, None if keep is None else int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "name string", self.keep)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.holder.get()
        least = None  # of a free key: the row that gets it unless a lesser one comes
        for batch in rows:
            batch = batch.drop(columns=KEY)
            if held is None:
                batch = (batch if least is None else pd.concat([least, batch])).sort_values(self.order, kind="stable")
                least, batch = batch.iloc[:1], batch.iloc[1:]
            if len(batch):
                yield batch.assign(first=False, holder=held[0] if held else None)
        if least is not None:
            name = str(least.iloc[0][self.name])
            self.holder.update((name,))
            yield least.assign(first=True, holder=name)


def once(requests: DataFrame, key: str, order: list[str], name: str, keep: timedelta | None = None) -> DataFrame:
    """Every request for a key, with `first` and `holder`: one request of a key is the first, and holds it.

    There is no watermark, so no request is too late to be answered. A key is held for good or, with `keep`, for that time from when
    its request was met (such a stream runs on: its batches don't end by themselves). Of the requests of one batch the least by
    `order` is first; the others of that batch don't know the holder (null), later ones do (its `name`)."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in requests.schema), T.StructField("first", T.BooleanType()), T.StructField("holder", T.StringType())])
    return stateful(requests).withColumn(KEY, F.col(key)).groupBy(KEY).transformWithStateInPandas(Claims(order, name, keep), schema, "Append", "None" if keep is None else "ProcessingTime")
