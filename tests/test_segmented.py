"""Islands over many partitions against one window, for one key that holds all rows and for many."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hitscope.operators import ranges, segmented, sessions

START = dt.datetime(2024, 1, 1)


def hits(n, keys, seed):
    r = random.Random(seed)
    return [(r.choice(keys), START + dt.timedelta(minutes=r.choice([0, r.randrange(300), r.randrange(20_000)]), seconds=r.randrange(3)), i) for i in range(n)]


@pytest.mark.parametrize("keys", [["one"], ["a", "b", None], [f"k{i}" for i in range(40)]])
@pytest.mark.parametrize("parts", [1, 7])
def test_sessions(spark, keys, parts):
    df = spark.createDataFrame(hits(600, keys, len(keys)), "key string, ts timestamp_ntz, i int")
    got = segmented.with_session_start(df, ["key"], parts=parts)
    expected = {r["i"]: r["session_start"] for r in sessions.with_session_start(df, ["key"]).collect()}
    assert {r["i"]: r["session_start"] for r in got.collect()} == expected and got.columns == ["key", "ts", "i", "session_start"]


def test_a_session_over_whole_partitions(spark):
    """Segments without a beginning of their own, several in a row."""
    df = spark.range(400).select(F.lit("k").alias("key"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    assert [r[0] for r in segmented.with_session_start(df, ["key"], parts=8).select("session_start").distinct().collect()] == [START]


@pytest.mark.parametrize("parts", [1, 6])
def test_ranges(spark, parts):
    r = random.Random(9)
    v4 = [("o", f"{a:08x}", f"{a + r.choice([0, 1, 3, 400]):08x}") for a in (r.randrange(30_000) for _ in range(500))] + [("o", "00000000", "00000fff"), ("p", "fffffff0", "ffffffff"), ("p", "ffffffff", "ffffffff")]
    v6 = [(None, f"{a:032x}", f"{a + 2:032x}") for a in (r.randrange(400) for _ in range(60))]
    df = spark.createDataFrame(v4 + v6, "owner string, first string, last string")
    assert sorted(map(str, segmented.merged(df, ["owner"], parts).collect())) == sorted(map(str, ranges.merged(df, ["owner"]).collect()))


def test_one_owner_is_many_tasks(spark):
    df = spark.range(5_000).select(F.lit("o").alias("owner"), F.lpad(F.lower(F.hex(F.col("id") * 3)), 8, "0").alias("first"), F.lpad(F.lower(F.hex(F.col("id") * 3 + 1)), 8, "0").alias("last"))
    rows = segmented._stored(df.repartitionByRange(8, "owner", "first").withColumn("_part", F.spark_partition_id()))
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 5_000 / 8
    assert segmented.merged(df, ["owner"], 8).count() == 5_000
