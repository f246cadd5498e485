"""The alert rules over all sites at once: each rule is one aggregation, whatever the number of sites.

A round finds the subjects (the MOST_SUBJECTS first of each rule and site), takes out those within their cooldown by an
anti-join with the state, delivers the rest from the executors, and gives the state after it. In a stream it runs in
foreachBatch, with the state read from where the round before left it. The rules are those of `alerts`.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitscope.plans.alerts import BASE_HOURS, KEPT_STATE, LEAST_HITS, MOST_SUBJECTS, _after, _from, _now
from hitscope.plans.panels import Panels, broken, genuine, hits, is_ai, n

KEY = ["rule", "site_id", "subject"]
STATE = "rule string, site_id string, subject string, at timestamp_ntz"
RULES = ("spike", "new_bot", "spoof", "broken_citation")


def _row(rule: str, subject: Column | str, value: str, base: Column | None = None) -> list[Column]:
    return [F.lit(rule).alias("rule"), F.col("site_id"), (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"), F.col(value).cast("bigint").alias("value"), (base if base is not None else F.lit(None)).cast("double").alias("base")]


def _spikes(p: Panels, factor: float) -> DataFrame:
    last = _after(p, dt.timedelta(hours=1))
    got = _now(p).filter(is_ai() & genuine() & _after(p, dt.timedelta(days=7))).groupBy("site_id").agg(n(last).alias("last_hour"), F.round(n(~last) / F.lit(BASE_HOURS), 9).alias("avg_hour"))
    loud = got.filter((F.col("last_hour") >= LEAST_HITS) & (F.col("avg_hour") > 0) & (F.col("last_hour") > factor * F.col("avg_hour")))
    return loud.select(*_row("spike", "ai", "last_hour", F.col("avg_hour")))


def _new_bots(p: Panels, minutes: int) -> DataFrame:
    window = dt.timedelta(minutes=minutes)
    recent = _from(p, window)
    each = _now(p).filter(_from(p, dt.timedelta(days=30))).groupBy("site_id", "bot_id").agg(n(recent & genuine()).alias("hits"), n(~recent).alias("earlier"))
    # a row for each bot of a site, so the window holds no more than the registry
    known = each.withColumn("site_earlier", F.sum("earlier").over(W.partitionBy("site_id")))
    fresh = known.filter((F.col("bot_id") != "") & (F.col("hits") > 0) & (F.col("earlier") == 0) & (F.col("site_earlier") > 0))
    return fresh.select(*_row("new_bot", F.col("bot_id"), "hits"))


def _spoofs(p: Panels, minutes: int) -> DataFrame:
    rows = _now(p).filter(~genuine() & _after(p, dt.timedelta(minutes=minutes)))
    return rows.groupBy("site_id", "bot_id").agg(hits().alias("hits")).select(*_row("spoof", F.col("bot_id"), "hits"))


def _broken(p: Panels, minutes: int) -> DataFrame:
    retrieval = F.col("actor_type").isin("ai_fetcher", "ai_search") & genuine()
    fine = (
        p._site((p.rollups or {})["daily_page_ai_stats"]).filter(retrieval & (F.col("date") > F.lit(p.as_of.date() - dt.timedelta(days=31))))
        .groupBy("site_id", "path_group").agg(F.sum("hits").alias("h"), F.sum("errors").alias("e")).filter("h > e").select("site_id", "path_group")
    )
    bad = _now(p).filter(retrieval & broken() & _after(p, dt.timedelta(minutes=minutes))).groupBy("site_id", "path_group").agg(hits().alias("errors"))
    return bad.join(fine, ["site_id", "path_group"], "left_semi").select(*_row("broken_citation", F.col("path_group"), "errors"))


def found(p: Panels, minutes: int = 10, factor: float = 3.0, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(rule, site_id, subject, value, base): the subjects of each rule and site, the first MOST_SUBJECTS by value."""
    made = {"spike": lambda: _spikes(p, factor), "new_bot": lambda: _new_bots(p, minutes), "spoof": lambda: _spoofs(p, minutes), "broken_citation": lambda: _broken(p, minutes)}
    rows = None
    for rule in rules:
        rows = made[rule]() if rows is None else rows.unionByName(made[rule]())
    order = W.partitionBy("rule", "site_id").orderBy(F.desc("value"), "subject")
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= MOST_SUBJECTS).drop("_k")


def live(state: DataFrame, now: dt.datetime, cooldown: dt.timedelta) -> DataFrame:
    """State within its cooldown, the newest KEPT_STATE entries of each site."""
    order = W.partitionBy("site_id").orderBy(F.desc("at"), "rule", "subject")
    recent = state.filter(F.col("at") > F.lit(now - cooldown).cast("timestamp_ntz"))
    return recent.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= KEPT_STATE).drop("_k")


def due(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Subjects that are not in the state. Sites and subjects are never null in enriched events."""
    return rows.join(state.select(*KEY), KEY, "left_anti")


def delivered(rows: DataFrame, deliver: Callable[[dict[str, Any]], bool], now: dt.datetime) -> DataFrame:
    """Delivers each row from the executor that holds it: the rows with `sent`. A delivery that fails is not sent."""
    at = now.isoformat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent = []
            for r in batch.to_pylist():
                detail = {"value": r["value"], "base": r["base"]}
                try:
                    sent.append(bool(deliver(json.loads(json.dumps({"rule": r["rule"], "site": r["site_id"], "subject": r["subject"], "detail": detail, "at": at})))))
                except Exception:  # one receiver's failure leaves the other alerts alone
                    sent.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent, pa.bool_())], [*batch.schema.names, "sent"])

    return rows.mapInArrow(run, "rule string, site_id string, subject string, value bigint, base double, sent boolean")


def tick(p: Panels, state: DataFrame, deliver: Callable[[dict[str, Any]], bool], now: dt.datetime, out: str, minutes: int = 10, factor: float = 3.0, cooldown: dt.timedelta = dt.timedelta(hours=6)) -> tuple[DataFrame, DataFrame]:
    """One round: what was due, with `sent`, and the state after it, both stored under `out`, so that nothing is delivered again when they are read."""
    spark = p.events.sparkSession
    before = live(state, now, cooldown)
    delivered(due(found(p, minutes, factor), before), deliver, now).write.mode("overwrite").parquet(f"{out}/alerts")
    told = spark.read.parquet(f"{out}/alerts")
    after = before.unionByName(told.filter("sent").select(*KEY, F.lit(now).cast("timestamp_ntz").alias("at")))
    after.write.mode("overwrite").parquet(f"{out}/state")
    return told, spark.read.parquet(f"{out}/state")
