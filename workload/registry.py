"""Where queries and their check SQL meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.checks import with_views
from workload.views import Feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, reads: str = "", sql: str | None = None):
    """Register ``fn(feeds)`` as a query; ``sql`` may use the views and checks in ``reads``."""

    def wrap(fn: Callable[[Feeds], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Feeds(spark, sf_dir)))
        if sql is not None:
            CHECKS[name] = with_views(tuple(reads.split()), sql)
        return fn

    return wrap


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that values compare alike across engines."""
    casts = {n: F.col(n).cast("double") for n, t in df.dtypes if t.startswith("decimal")}
    casts |= {n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"}
    return df.withColumns(casts) if casts else df
