"""What a job tells while it runs: metrics that are taken as rows pass, without a pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from quire.sources.session import written


def watched(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """df as a written table, and the metrics (aggregates) of its rows, taken in the job that wrote it."""
    seen = Observation()
    table = written(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), name)
    return table, seen.get


class Told(StreamingQueryListener):
    """Collects the metrics that a stream's batches were given by `observe`: (name of the metrics, batch, values), batches without rows left out."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, dict]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            if event.progress.numInputRows:
                self.rows.append((name, event.progress.batchId, row.asDict()))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def listening(spark: SparkSession) -> Told:
    """A listener of all streams of the session from now on; `spark.streams.removeListener` ends it."""
    told = Told()
    spark.streams.addListener(told)
    return told
