"""Sessions: hits of one key belong together while each comes at most 30 minutes after the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitscope.functions.request import id_of

IDLE_MINUTES = 30


def session_key() -> Column:
    return F.concat_ws("|", "site_id", F.col("ip_hash").cast("string"), "ua")


def start_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, whatever the session's zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return (seconds * 1000 + F.date_format(ts, "SSS").cast("int")).cast("string")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    whole = F.unix_date(F.to_date(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def with_session_start(df: DataFrame, keys: list[str], ts: str = "ts", parts: int | None = None) -> DataFrame:
    """Adds session_start. A key that holds very many rows is still one window; keys here end with the UTC day. parts: how
    many tasks sort the rows; by default as many as the shuffle has, whatever the number of rows."""
    df = df.repartition(parts, *keys) if parts else df
    order = W.partitionBy(*keys).orderBy(ts)
    gap = F.col(ts) > F.lag(ts).over(order) + F.expr(f"interval {IDLE_MINUTES} minutes")
    begun = df.withColumn("_begin", F.when(F.coalesce(gap, F.lit(True)), F.col(ts)))
    return begun.withColumn("session_start", F.last("_begin", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_begin")


def with_session_id(df: DataFrame) -> DataFrame:
    """Adds session_id from site_id, ip_hash, ua and the session's start."""
    return with_id_of_start(with_session_start(df, ["site_id", "ip_hash", "ua"]))


def with_id_of_start(started: DataFrame) -> DataFrame:
    """session_start replaced by session_id."""
    return started.withColumn("session_id", id_of(F.concat_ws(" ", session_key(), start_millis(F.col("session_start"))))).drop("session_start")
