"""Compaction of rollup partials: same sums, each batch once, readers unharmed, few folders."""

import datetime as dt
import glob

import pytest

from hitscope.operators import rollups
from hitscope.streaming import compaction

NAME = "daily_referrals"
SCHEMA = "site_id string, date date, ai_referral string, path_group string, hits long"


def merge(df):
    return rollups.merge(df.drop("batch"), name=NAME)


def write(spark, path, batch, hits=1):
    rows = [("s", dt.date(2024, 1, 1), "chatgpt", "/a", hits), ("s", dt.date(2024, 1, 1 + batch % 3), "claude", "/b", 10 * hits)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def total(spark, path):
    return compaction.read(spark, path, merge).agg({"hits": "sum"}).first()[0]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / NAME)
    for i in range(4):
        write(spark, path, i)
    return path


def test_sums_stay_and_folders_are_few(spark, tmp_path):
    path = str(tmp_path / NAME)
    for i in range(14):
        write(spark, path, i)
        compaction.compact(spark, path, merge, i - 1, fanout=3)
        compaction.vacuum(spark, path, kept=1)
    assert total(spark, path) == 14 * 11
    assert len(compaction.parts(spark, path)) <= 6
    tiers = [r["tier"] for r in compaction.manifest(spark, path).runs]
    assert max(tiers) >= 2 and len(tiers) == len(set(tiers)) or tiers.count(max(tiers)) < 3
    assert len(glob.glob(f"{path}/batch=*")) <= 6


def test_too_few_batches_stay(spark, table):
    assert not compaction.compact(spark, table, merge, 1, fanout=3)
    assert total(spark, table) == 44


def test_a_reader_during_compaction_is_unharmed(spark, table):
    before = compaction.read(spark, table, merge)
    assert compaction.compact(spark, table, merge, 3, fanout=4)
    write(spark, table, 4)
    assert compaction.vacuum(spark, table) == []
    assert before.agg({"hits": "sum"}).first()[0] == 44 and total(spark, table) == 55


def test_a_replayed_batch_counts_once(spark, table):
    assert compaction.compact(spark, table, merge, 3, fanout=4)
    write(spark, table, 3)
    assert total(spark, table) == 44
    write(spark, table, 4, hits=5)
    write(spark, table, 4)
    assert total(spark, table) == 55


def test_of_two_compactions_one_gives_way(spark, table):
    folder = compaction.Folder(spark, table)
    real = compaction.manifest

    def late(spark, path):
        got = real(spark, path)
        folder.publish(f"_manifest/{got.version + 1:09d}.json", '{"covered": -1, "runs": [], "gone": []}')
        return got

    compaction.manifest = late
    try:
        assert not compaction.compact(spark, table, merge, 3, fanout=4)
    finally:
        compaction.manifest = real
    assert not glob.glob(f"{table}/run-*") and total(spark, table) == 44
