"""Sketches against exact counts: the error's bound, and that the union of days is the whole."""

import datetime as dt

from pyspark.sql import functions as F

from hitscope.operators import sketches


def events(spark, n=60_000):
    day = F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(F.pmod(F.col("id"), F.lit(5)).cast("int"))
    return spark.range(n).select(
        F.lit("s").alias("site_id"), day.cast("timestamp_ntz").alias("ts"), F.pmod(F.xxhash64("id"), F.lit(9000)).cast("decimal(20,0)").alias("ip_hash"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(25_000)).cast("decimal(20,0)").alias("session_id"), F.concat(F.lit("/p"), (F.col("id") % 700).cast("string")).alias("path_group"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("b"), (F.col("id") % 40).cast("string"))).otherwise("").alias("bot_id"),
    )


def near(got, expected, share=0.04):
    return all(abs(got[c] - expected[c]) <= share * expected[c] for c in sketches.COUNTED)


def test_error_and_union_of_days(spark):
    rows = events(spark)
    daily = sketches.build(rows)
    assert daily.count() == 5
    exact = {r["date"]: r for r in sketches.exact(rows).collect()}
    assert all(near(r, exact[r["date"]]) for r in sketches.counts(daily).collect())
    whole = sketches.counts(sketches.merge(sketches.build(rows.withColumn("ts", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))), ["site_id"])).first()
    union = sketches.window(daily, "2024-01-01", "2024-01-05").first()
    assert near(union, exact[None]) and near(whole, exact[None]) and near(union, whole, 0.02)


def test_partials_merge_in_any_order(spark):
    rows = events(spark, 20_000)
    halves = [sketches.build(rows.filter(F.col("session_id") % 2 == k)) for k in (0, 1)]
    merged = sketches.counts(sketches.merge(halves[0].unionByName(halves[1]))).orderBy("date").collect()
    again = sketches.counts(sketches.merge(halves[1].unionByName(halves[0]).unionByName(halves[0]))).orderBy("date").collect()
    exact = {r["date"]: r for r in sketches.exact(rows).collect()}
    assert all(near(a, exact[a["date"]]) and near(b, a, 0.01) for a, b in zip(merged, again, strict=True))
