"""The streaming ingest against the batch enrichment, over several micro-batches."""

import datetime as dt

import pytest

from hitscope.operators.enrich import RAW, Dimensions, enrich
from hitscope.operators import rollups, sketches
from hitscope.streaming import compaction, job

BROWSER = "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0"
START = dt.datetime(2024, 3, 1, 10)


def hit(minutes, ip="192.0.2.1", ua=BROWSER, path="/a"):
    return ("s", START + dt.timedelta(minutes=minutes), ip, "GET", path, 200, 10, ua, "", 1.0, None, None, None)


BATCHES = [
    [hit(0), hit(0.1, path="/x.css"), hit(1, ip="192.0.2.2"), hit(2, ua="CCBot/2.0")],
    [hit(0.2, path="/b"), hit(29), hit(40, ip="192.0.2.2"), ("s", None, "1.1.1.1", "GET", "/", 200, 0, "", "", 0.0, None, None, None)],
    [hit(50), hit(81), hit(2.5, ua="CCBot/2.0", path="/c")],
]


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    folder = base / "in"
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(base / f"part{i}"))
    folder.mkdir()
    for i in range(len(BATCHES)):  # one file, thus one micro-batch, after the other
        (file,) = (base / f"part{i}").glob("*.parquet")
        file.rename(folder / f"{i}.parquet")
        stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(folder))
        job.ingest(stream, str(base / "out"), str(base / "checkpoint"), Dimensions(), "k", {"availableNow": True}).awaitTermination()
    return str(base / "out")


def test_same_as_batch(spark, ingested):
    got = spark.read.parquet(f"{ingested}/events").drop("batch")
    every = spark.createDataFrame([r for rows in BATCHES for r in rows if r[1] is not None], RAW)
    expected = enrich(every, Dimensions(), "k")
    assert got.count() == 10
    assert got.exceptAll(expected.select(*got.columns)).count() == 0
    # 192.0.2.1: minutes 0 to 50 are one session, 81 another; 192.0.2.2: two; the crawler: one
    assert got.select("session_id").distinct().count() == 5
    assert spark.read.parquet(f"{ingested}/rejected").select("issue").collect()[0][0] == "ts"
    same = lambda: rollups.difference(job.read_rollup(spark, ingested, "daily_bot_stats"), got, "daily_bot_stats").count() == 0
    distinct = lambda: sketches.counts(job.read_rollup(spark, ingested, "daily_distinct")).first().asDict()
    exact = sketches.exact(got).filter("date is not null").first().asDict()
    assert same() and distinct() == exact
    job.compact(spark, ingested, 1, fanout=2)
    assert len(compaction.parts(spark, f"{ingested}/daily_bot_stats")) == 2
    assert same() and distinct() == exact


class Memory:
    """Stands in for the state store's handle."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.remove(t)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_sessions_of_a_key():
    from pyspark.sql import Row

    store = Memory()
    sessions = job.Sessions(1000)
    sessions.init(store)
    minute = 60_000_000

    def at(now, *minutes):
        store.now = now
        return [r["_begun"] // minute for r in sessions.handleInputRows(("k",), iter([Row(_at=m * minute, _issue=None, event=None) for m in minutes]), store)]

    assert at(0, 0) == [0] and store.timers == {1000}
    assert at(10, 60, 30) == [0, 0] and store.timers == {1010}  # in order of time: 30, then 60
    assert at(20, -5) == [0]
    assert at(30, 91, 130) == [91, 130] and store.timers == {1030}
    assert list(sessions.handleExpiredTimer(("k",), store, None)) == [] and not store.exists()
    assert at(2000, 131) == [131]


def test_idle_keys_are_forgotten_by_timer(spark, tmp_path):
    """With next to no time kept, the first visitor's state ends in the second micro-batch, so a hit ten minutes later begins a session."""
    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[hit(0)], [hit(5, ip="192.0.2.9")], [hit(10)]]):
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (file,) = (tmp_path / f"part{i}").glob("*.parquet")
        file.rename(tmp_path / "in" / f"{i}.parquet")
        stream = spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))
        job.ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), Dimensions(), "k", {"availableNow": True}, kept_minutes=0.00002).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert got.count() == 3 and got.select("session_id").distinct().count() == 3
