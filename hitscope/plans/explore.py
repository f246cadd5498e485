"""One metric by one dimension, under up to five equality filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(c: str, empty: str) -> Column:
    return F.when(F.col(c) == "", empty).otherwise(F.col(c))


METRICS: dict[str, Callable[[], Column]] = {
    "hits": lambda: F.count(F.lit(1)),
    "bots": lambda: F.countDistinct(F.when(F.col("bot_id") != "", F.col("bot_id"))),
    "pages": lambda: F.countDistinct("path_group"),
    "sessions": lambda: F.countDistinct("session_id"),
    "bytes": lambda: F.sum("bytes"),
    "errors": lambda: F.count_if(F.col("status") >= 400),
}
DIMENSIONS: dict[str, Callable[[], Column]] = {
    "bot_id": lambda: _named("bot_id", "(none)"),
    "operator": lambda: _named("operator", "(none)"),
    "actor_type": lambda: F.col("actor_type"),
    "verification": lambda: F.col("verification"),
    "country": lambda: _named("country", "(unknown)"),
    "as_org": lambda: _named("as_org", "(unknown)"),
    "path_group": lambda: F.col("path_group"),
    "status": lambda: F.concat((F.col("status") / 100).cast("int").cast("string"), F.lit("xx")),
    "ai_referral": lambda: _named("ai_referral", "(none)"),
    "hour": lambda: F.hour("ts").cast("string"),
    "weekday": lambda: (F.weekday("ts") + 1).cast("string"),
    "ingest_source": lambda: F.col("ingest_source"),
}
FILTERS = ["actor_type", "verification", "operator", "country", "bot_id"]


def explore(window: DataFrame, metric: str, dimension: str, filters: dict[str, str] | None = None, limit: int = 50) -> DataFrame:
    """(key, value), largest first, over the events of a window. Filters compare the stored value, not the shown one;
    an empty filter value is no filter; unknown names are errors."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension!r}")
    rows = window
    for name, value in (filters or {}).items():
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name!r}")
        if value:
            rows = rows.filter(F.col(name) == value)
    return rows.groupBy(DIMENSIONS[dimension]().alias("key")).agg(METRICS[metric]().cast("bigint").alias("value")).orderBy(F.desc("value"), "key").limit(limit)
