"""Every query over the driver's tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import arrivals as _arrivals
from quire.plans import further as _further
from quire.plans import more as _more
from quire.plans import queries as _queries
from quire.plans import trees as _trees
from quire.sources.session import importable

Query = Callable[[SparkSession, str], DataFrame]


def _run(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(importable(spark), sf_dir)

    run.__name__ = f.__name__
    return run


def queries() -> dict[str, Query]:
    return {name: _run(f) for name, f in (_queries.QUERIES | _trees.QUERIES | _more.QUERIES | _arrivals.QUERIES | _further.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return _queries.SQL | _trees.SQL | _more.SQL | _arrivals.SQL | _further.SQL
