"""Daily rollups of enriched events: built, merged, rebuilt and checked. Partials add up, so readers always sum."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sums() -> dict[str, Column]:
    return {
        "hits": F.count(F.lit(1)).cast("bigint").alias("hits"), "bytes": F.sum("bytes").alias("bytes"),
        "errors": F.count_if(F.col("status") >= 400).cast("bigint").alias("errors"),
    }


KEYS = {
    "daily_bot_stats": ["site_id", "date", "actor_type", "bot_id", "operator", "verification"],
    "daily_page_stats": ["site_id", "date", "path_group", "actor_type", "operator"],
    "daily_referrals": ["site_id", "date", "ai_referral", "path_group"],
    "daily_page_ai_stats": ["site_id", "date", "path_group", "actor_type", "verification"],
}
SUMS = {
    "daily_bot_stats": ["hits", "bytes", "errors"], "daily_page_stats": ["hits", "errors"], "daily_referrals": ["hits"], "daily_page_ai_stats": ["hits", "errors"],
}


def build(events: DataFrame, name: str) -> DataFrame:
    """A rollup of some events: partial if they are some of a day's."""
    rows = events.withColumn("date", F.to_date("ts"))
    if name == "daily_referrals":
        rows = rows.filter("ai_referral != ''")
    if name == "daily_page_ai_stats":
        rows = rows.filter(F.startswith("actor_type", F.lit("ai_")))
    sums = _sums()
    return rows.groupBy(*KEYS[name]).agg(*[sums[s] for s in SUMS[name]])


def merge(*parts: DataFrame, name: str) -> DataFrame:
    """Partials to one row a key."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*KEYS[name]).agg(*[F.sum(s).alias(s) for s in SUMS[name]])


def rebuild(events: DataFrame, name: str, as_of: dt.datetime, days: int = 365) -> DataFrame:
    """A rollup anew, from the last `days` days of events only."""
    return build(events.filter(F.to_date("ts") >= F.lit(as_of.date() - dt.timedelta(days=days))), name)


def difference(rollup: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """Rows in which a rollup and the events' own aggregation differ, either way; empty if they agree."""
    cols = KEYS[name] + SUMS[name]
    a, b = merge(rollup, name=name).select(*cols), build(events, name).select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("rollup")).unionByName(b.exceptAll(a).withColumn("side", F.lit("events")))


def expired_months(months: list[str], as_of: dt.datetime, keep: int = 13) -> list[str]:
    """Which month partitions (YYYYMM) are wholly older than the retention."""
    n = as_of.year * 12 + as_of.month - 1 - keep
    limit = f"{n // 12:04d}{n % 12 + 1:02d}"
    return [m for m in months if m < limit]
