"""Islands of rows for keys of any size: sessions, and ranges that join, without one key being one task's window.

Rows are dealt out by ranges of (key, first), so a large key lies in several partitions, in order. Each partition is
scanned by itself, with a running maximum of how far its rows reach. A key that crosses an edge between two partitions (at
most one does, at each edge) then hands over, from segment to segment, how far it had reached and where its open island
began: two small tables, of a row for each segment of those keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitscope.operators.ranges import after
from hitscope.operators.sessions import IDLE_MINUTES
from hitscope.storage import shared_dir


def _stored(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/hitscope/segments-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def islands(df: DataFrame, keys: list[str], first: str, reach: str, joins: Callable[[Column, Column], Column], out: str, parts: int | None = None) -> DataFrame:
    """Adds `out`: the `first` of the row that began each row's island. In order of first, a row goes on with the island of
    its key before it if joins(the furthest reach of all rows before it, its first), else it begins one. Null keys are
    equal. parts: how many ranges; by default as many as the shuffle has."""
    ranged = df.repartitionByRange(parts, *keys, first) if parts else df.repartitionByRange(*keys, first)
    rows = _stored(ranged.withColumn("_part", F.spark_partition_id()))
    same = lambda t: [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_part") == F.col(f"_part_{t}")]
    named = lambda seg, t: seg.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias(f"_part_{t}"), *[c for c in seg.columns if c not in (*keys, "_part")])
    bare = lambda df, t: df.drop(*[f"_key_{k}" for k in keys], f"_part_{t}")
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)

    spread = rows.groupBy(*keys).agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi")).filter("_lo < _hi")
    crossing = F.broadcast(spread.select(*[F.col(k).alias(f"_key_{k}") for k in keys]))
    of_crossing = rows.join(crossing, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], "left_semi")
    reached = of_crossing.groupBy(*keys, "_part").agg(F.max(reach).alias("_r")).withColumn("_carried", F.max("_r").over(earlier)).withColumn("_crosses", F.lit(True)).drop("_r")
    reached = F.broadcast(_stored(named(reached, "r")))

    held = W.partitionBy(*keys, "_part").orderBy(first, reach)
    scanned = bare(rows.join(reached, same("r"), "left"), "r")
    before = F.greatest("_carried", F.max(reach).over(held.rowsBetween(W.unboundedPreceding, -1)))
    marked = scanned.withColumn("_before", before).withColumn("_begun", F.when(F.coalesce(~joins(F.col("_before"), F.col(first)), F.lit(True)), F.col(first)))
    started = marked.withColumn("_start", F.max("_begun").over(held.rowsBetween(W.unboundedPreceding, 0)))
    opened = started.filter("_crosses").groupBy(*keys, "_part").agg(F.max("_start").alias("_s")).withColumn("_open", F.max("_s").over(earlier)).drop("_s")
    opened = F.broadcast(_stored(named(opened, "s")))
    done = bare(started.join(opened, same("s"), "left"), "s")
    return done.withColumn(out, F.coalesce("_start", "_open")).drop("_part", "_carried", "_crosses", "_before", "_begun", "_start", "_open")


def with_session_start(df: DataFrame, keys: list[str], ts: str = "ts", parts: int | None = None) -> DataFrame:
    """As sessions.with_session_start, for keys of any size."""
    idle = F.expr(f"interval {IDLE_MINUTES} minutes")
    return islands(df, keys, ts, ts, lambda seen, now: now <= seen + idle, "session_start", parts)


def merged(ranges: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """As ranges.merged, for owners of any size."""
    rows = ranges.select(*by, F.char_length("first").alias("_f"), "first", "last")
    joined = islands(rows, [*by, "_f"], "first", "last", lambda reach, first: first <= F.coalesce(after(reach), reach), "_begin", parts)
    return joined.groupBy(*by, "_f", "_begin").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_f", "_begin")
