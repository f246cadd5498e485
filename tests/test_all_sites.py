"""Alerts of all sites at once against the round of one site after the other."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hitscope.operators import rollups
from hitscope.plans import alerts, all_sites
from hitscope.plans.panels import Panels

NOW = dt.datetime(2024, 3, 10, 12)
EVENT = "site_id string, ts timestamp_ntz, actor_type string, bot_id string, operator string, verification string, path_group string, status int, bytes bigint, ai_referral string"
SITES = 60


@pytest.fixture(scope="module")
def panels(spark, tmp_path_factory):
    """Sites of several kinds: loud, with new bots, forged ones, pages that break; 30 bots and pages on some, so that the limit counts."""
    rows = spark.range(SITES * 120).select(F.concat(F.lit("s"), (F.col("id") % SITES).cast("string")).alias("site_id"), (F.col("id") % SITES).cast("int").alias("k"), F.floor(F.col("id") / SITES).cast("int").alias("i"))
    ago = F.when((F.col("k") % 3 == 0) & (F.col("i") < 100), F.col("i") % 50).otherwise(F.col("i") * 37 % 9000)
    made = rows.select(
        "site_id", (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(mins=ago.cast("int"))).alias("ts"),
        F.when(F.col("i") % 4 == 0, "ai_fetcher").when(F.col("i") % 4 == 1, "ai_training").otherwise("human").alias("actor_type"),
        F.when(F.col("i") % 4 < 2, F.concat(F.lit("b"), ((F.col("i") + F.col("k")) % 30).cast("string"))).otherwise("").alias("bot_id"), F.lit("o").alias("operator"),
        F.when(F.col("i") % 7 == 0, "spoofed").otherwise("na").alias("verification"), F.concat(F.lit("/p"), (F.col("i") % 26).cast("string")).alias("path_group"),
        F.when(F.col("i") % 3 == 0, 404).otherwise(200).alias("status"), F.lit(1).cast("bigint").alias("bytes"), F.lit("").alias("ai_referral"),
    )
    folder = str(tmp_path_factory.mktemp("events"))
    made.write.parquet(f"{folder}/events")
    events = spark.read.parquet(f"{folder}/events")
    rollups.build(events, "daily_page_ai_stats").write.parquet(f"{folder}/pages")
    return Panels(events, NOW, {"daily_page_ai_stats": spark.read.parquet(f"{folder}/pages")})


def test_same_as_the_loop(panels):
    got = {}
    for r in all_sites.found(panels, 40, 1.5).collect():
        got.setdefault((r["rule"], r["site_id"]), []).append((r["subject"], r["value"]))
    for site in ("s0", "s1", "s2", "s3", "s59"):
        one = Panels(panels.events, NOW, panels.rollups, site)
        expected = {
            "spike": [("ai", r["last_hour"]) for r in alerts.spike(one, 1.5).collect()], "new_bot": [(r["bot_id"], r["hits"]) for r in alerts.new_bots(one, 40).collect()],
            "spoof": [(r["bot_id"], r["hits"]) for r in alerts.spoofed(one, 40).collect()], "broken_citation": [(r["path_group"], r["errors"]) for r in alerts.broken_citations(one, 40).collect()],
        }
        assert {rule: sorted(got.get((rule, site), [])) for rule in all_sites.RULES} == {k: sorted(v) for k, v in expected.items()}
    assert {rule for rule, _ in got} == set(all_sites.RULES)


def test_round_and_cooldown(spark, panels, tmp_path):
    fails = lambda e: e["site"] == "s6" and e["rule"] == "spoof"

    def deliver(event):
        if fails(event) and event["subject"] == "b1":
            raise OSError("down")
        return not fails(event)

    none = spark.createDataFrame([], all_sites.STATE)
    told, state = all_sites.tick(panels, none, deliver, NOW, str(tmp_path / "1"), 40, 1.5)
    rows = told.collect()
    assert rows and {r["sent"] for r in rows if r["site_id"] == "s6" and r["rule"] == "spoof"} == {False}
    assert state.count() == sum(r["sent"] for r in rows)
    again, after = all_sites.tick(panels, state, deliver, NOW, str(tmp_path / "2"), 40, 1.5)
    assert {(r["rule"], r["site_id"]) for r in again.collect()} == {("spoof", "s6")} and after.count() == state.count()
    later = all_sites.live(state, NOW + dt.timedelta(hours=6), dt.timedelta(hours=6))
    assert later.count() == 0


def test_jobs_do_not_grow_with_sites(spark, panels, tmp_path):
    jobs = {}
    for n in (2, SITES):
        few = Panels(panels.events.filter(F.substring("site_id", 2, 9).cast("int") < n), NOW, panels.rollups)
        spark.sparkContext.setJobGroup(f"round {n}", "")
        all_sites.tick(few, spark.createDataFrame([], all_sites.STATE), lambda e: True, NOW, str(tmp_path / str(n)), 40, 1.5)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"round {n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[SITES] <= jobs[2] + 3
