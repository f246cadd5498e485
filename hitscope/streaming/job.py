"""The ingest job: a stream of raw events to enriched events and rollup partials, exactly once per micro-batch.

Sessions are keyed state in the state store: what a micro-batch reads and writes of it is the keys it holds, not all that
are open. A timer for each key ends its state. Every micro-batch writes below batch=<id>; a replayed batch overwrites its
own folder, so nothing is counted twice. Late events are kept: partials add up whenever they come. Partials are merged in
place as batches go by (`compaction`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from hitscope.functions.request import visitor_hash
from hitscope.operators import rollups, sketches
from hitscope.operators.enrich import Dimensions, enrich, first_issue
from hitscope.operators.sessions import IDLE_MINUTES, micros
from hitscope.streaming import compaction

#: How long after its last hit a key's session is still known, in minutes of the clock.
KEPT_MINUTES = 24 * 60
#: Keyed state with timers needs this store; timers of the clock would else keep a stream without new data running batch after batch.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


class Sessions(StatefulProcessor):
    """The open session of a key: its start and last hit, in microseconds, and when it is to be forgotten.

    A hit at most IDLE_MINUTES after the last one belongs to the open session, and so does any late hit; hits of one
    micro-batch count by time. A key without a hit for the time kept is forgotten by its timer, so that its next hit
    begins a session. Rows with an issue pass.
    """

    def __init__(self, kept_ms: int) -> None:
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, seen long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        hits = sorted(rows, key=lambda r: r["_at"] if r["_at"] is not None else 0)
        held = self.open.get() if self.open.exists() else None
        start, seen, due = held if held is not None else (None, None, None)
        for r in hits:
            if r["_issue"] is None:
                if seen is None or r["_at"] > seen + IDLE_MINUTES * 60_000_000:
                    start = r["_at"]
                seen = r["_at"] if seen is None else max(seen, r["_at"])
            yield Row(_begun=start if r["_issue"] is None else None, _issue=r["_issue"], event=r["event"])
        if seen is not None:
            if due is not None:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.kept_ms
            self.handle.registerTimer(due)
            self.open.update((start, seen, due))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_sessions(stream: DataFrame, secret: str, kept_minutes: float = KEPT_MINUTES) -> DataFrame:
    """A stream of raw events with session_start and issue: the first field that is not valid, or null."""
    own = F.concat_ws("|", F.lit("s"), "site_id", visitor_hash(F.col("ip"), F.col("ts"), secret).cast("string"), F.coalesce("ua", F.lit("")))
    # rows that are not valid have no session; they are dealt out by their content
    other = F.concat_ws("|", F.lit("x"), F.hash(*stream.columns).cast("string"))
    rows = stream.select(first_issue().alias("_issue"), F.struct(*stream.columns).alias("event"), micros(F.col("ts")).alias("_at"), own.alias("_own"), other.alias("_other"))
    keyed = rows.select(F.when(F.col("_issue").isNull(), F.col("_own")).otherwise(F.col("_other")).alias("_key"), "_at", "_issue", "event")
    schema = T.StructType([T.StructField("_begun", T.LongType()), T.StructField("_issue", T.StringType()), T.StructField("event", T.StructType(stream.schema.fields))])
    told = keyed.groupBy("_key").transformWithState(Sessions(int(kept_minutes * 60_000)), schema, "Append", "ProcessingTime")
    start = F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, cast(_begun as decimal(24, 0)) / 1000000)")
    return told.select("event.*", start.alias("session_start"), F.col("_issue").alias("issue"))


def write_batch(told: DataFrame, batch_id: int, out: str, dims: Dimensions, secret: str) -> None:
    """One micro-batch with its sessions: valid events enriched, rejected ones beside them, each rollup's partial.

    The batch is stored first, as enrichment reads it several times and the state must be asked once only.
    """
    spark = told.sparkSession
    staged = f"{out}/staged/{batch_id % 2}"
    told.write.mode("overwrite").parquet(staged)
    told = spark.read.schema(told.schema).parquet(staged)
    enrich(told.filter("issue is null").drop("issue"), dims, secret).write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
    told.filter("issue is not null").drop("session_start").write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
    events = spark.read.parquet(f"{out}/events/batch={batch_id}")
    for name in rollups.KEYS:
        rollups.build(events, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
    sketches.build(events).write.mode("overwrite").parquet(f"{out}/daily_distinct/batch={batch_id}")
    if batch_id % compaction.FANOUT == 0:  # this batch itself may be replayed, those before it never
        compact(spark, out, batch_id - 1)


def ingest(
    stream: DataFrame, out: str, checkpoint: str, dims: Dimensions, secret: str, trigger: dict[str, Any] | None = None, kept_minutes: float = KEPT_MINUTES
) -> StreamingQuery:
    """Raw events to tables. Sessions go on across micro-batches and restarts.

    The query takes SETTINGS from the session as it starts; they are then put back."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:
        return (
            with_sessions(stream, secret, kept_minutes).writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"}))
            .foreachBatch(lambda told, batch_id: write_batch(told, batch_id, out, dims, secret)).start()
        )
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _mergers() -> dict[str, compaction.Merge]:
    """The tables of partials, and how their partials merge."""
    of = lambda name: lambda df: rollups.merge(df.drop("batch"), name=name)
    return {name: of(name) for name in rollups.KEYS} | {"daily_distinct": lambda df: sketches.merge(df.drop("batch"))}


def compact(spark: SparkSession, out: str, upto: int, fanout: int = compaction.FANOUT) -> None:
    """Merges the partials of batches up to `upto` where there are enough, and removes what no reader needs any more."""
    for name, merge in _mergers().items():
        if compaction.compact(spark, f"{out}/{name}", merge, upto, fanout):
            compaction.vacuum(spark, f"{out}/{name}")


def read_rollup(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A rollup, or the sketches daily_distinct: all partials, merged."""
    return compaction.read(spark, f"{out}/{name}", _mergers()[name])
