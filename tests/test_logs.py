"""Log lines of each format to events: good lines, sentinels and lines that are refused."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hitscope.functions import logfields
from hitscope.sources import logs, sinks

GOOD = '203.0.113.9 - - [10/Jun/2024:12:30:00 +0200] "get /a?x=1 HTTP/1.1" 200 512 "https://x.example/" "Agent \\"q\\" 1"'
CASES = {
    "apache": [GOOD, '2001:db8::1 id me [10/Jun/2024:12:30:00 -0500] "GET /b HTTP/2" 304 -', '1.2.3.4 - - [31/Feb/2024:12:30:00 +0000] "GET / HTTP/1.1" 200 1', "broken", ""],
    "nginx-combined": [GOOD, '1.2.3.4 - - [10/Jun/2024:12:30:00 +0000] "GET /b HTTP/1.1" 200 1'],
    "nginx-json": ['{"time_iso8601": "2024-06-10T12:30:00+02:00", "remote_addr": "1.2.3.4", "request_method": "GET", "request_uri": "/c", "status": "200", "body_bytes_sent": 7, "request_time": "0.25"}', "not json"],
    "caddy-json": ['{"ts": 1718015400.5, "request": {"remote_ip": "1.2.3.4", "method": "GET", "uri": "/d", "headers": {"USER-AGENT": ["A"]}}, "status": 200, "size": "-", "duration": 0.002}', '{"ts": 1718015400, "request": {"remote_ip": "1.2.3.4", "method": "GET"}, "status": 200}'],
    "cloudflare-ndjson": ['{"EdgeStartTimestamp": 1718015400000000000, "ClientIP": "1.2.3.4", "ClientRequestMethod": "GET", "ClientRequestURI": "https://h.example/e?y", "EdgeResponseStatus": 200, "EdgeResponseBytes": 9}', '{"ClientIP": "1.2.3.4"}'],
}


def parsed(spark, name, lines, field_map=None):
    return logs.parse(spark.createDataFrame([(x,) for x in lines], "line string"), name, field_map)


@pytest.mark.parametrize("name", CASES)
def test_formats(spark, name):
    rows = logs.events(parsed(spark, name, CASES[name]), "s").collect()
    assert len(rows) == (2 if name == "apache" else 1)
    first = next(r for r in rows if r["status"] == 200)
    path = {"nginx-json": "/c", "caddy-json": "/d", "cloudflare-ndjson": "/e?y"}.get(name, "/a?x=1")
    assert (first["method"], first["path"], first["site_id"]) == ("GET", path, "s")
    assert first["ts"].replace(microsecond=0) == dt.datetime(2024, 6, 10, 10, 30)
    if name == "caddy-json":
        assert (first["ua"], first["bytes"], first["response_ms"]) == ("A", 0, 2.0)
    if name == "nginx-json":
        assert first["response_ms"] == 250.0
    if name in ("apache", "nginx-combined"):
        assert first["ua"] == 'Agent "q" 1' and first["bytes"] == 512


def test_jsonl(spark):
    fields = logs.field_map_of("ts=when,ip=client.ip,method=http.method,path=http.target,status=response.status")
    lines = ['{"when": "2024-06-10T10:30:00Z", "client": {"ip": "1.2.3.4"}, "http": {"method": "GET", "target": "/f"}, "response": {"status": 200}}', '{"when": 1}']
    rows = logs.events(parsed(spark, "jsonl", lines, fields), "s").collect()
    assert [(r["path"], r["bytes"]) for r in rows] == [("/f", 0)]


def test_csv_text():
    assert sinks.to_csv([]) == ""
    assert sinks.to_csv([{"a": 'x"y', "b": None}, {"a": "p,q", "b": 1}]) == 'a,b\n"x""y",\n"p,q",1\n'


def test_times_and_methods(spark):
    """Times of the common shape are read by a shorter way; it gives what the longer one gives."""
    times = ["2024-06-10T12:30:00Z", "2024-06-10 12:30:00.123456", "2024-06-10T12:30:00z", "2024-06-10T12:30:00.5+02:00", "2024-06-10T12:30", "2024-06-10", "2024-02-30T12:30:00Z", "2024-06-10T12:30:00ZZ", "T2024", "2024-06-10T25:30:00Z"]
    df = spark.createDataFrame([(x,) for x in times], "x string")
    rows = df.select("x", logfields.iso_time(F.col("x")).alias("a"), logfields._any_iso_time(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert [r["a"] is None for r in rows] == [False] * 6 + [True] * 4
    clf = ["10/Jun/2024:12:30:00 +0200", "10/jun/2024:12:30:00 +0200", "1/Jun/2024:12:30:00 +0200", "10/Jun/2024:12:30:00 -0030", "31/Feb/2024:12:30:00 +0000"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in clf], "x string").select(logfields.clf_time(F.col("x"))).collect()]
    assert got == [dt.datetime(2024, 6, 10, 10, 30), None, None, dt.datetime(2024, 6, 10, 13, 0), None]
    words = ["get", " Post ", "M-SEARCH", "g\u0131t", "g\u00e9t", "a b", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in words], "x string").select(logfields.method(F.col("x"))).collect()]
    assert got == ["GET", "POST", "M-SEARCH", "GIT", None, None, None]


@pytest.mark.parametrize("name", ["nginx-json", "caddy-json", "cloudflare-ndjson"])
def test_each_lookup_is_made_once(spark, name):
    """A field is looked up in the line once, not anew wherever its value is used."""
    plan = logs.parse(spark.createDataFrame([("{}",)], "line string").repartition(2), name)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") <= 21  # names that nginx fields may have
