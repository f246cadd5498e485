"""Every branch of reverse and forward confirmation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hitscope.operators import fcrdns
from hitscope.operators.enrich import RAW, Dimensions, enrich

START = dt.datetime(2024, 3, 1, 10, 59)
BOT = {"bot_id": "b", "operator": "o", "actor_type": "search_engine", "ua_patterns": ["BBot"], "ip_source": None, "rdns_suffixes": [".b.example", "crawl.example"], "docs_url": None}


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def ptr(ip, names, minutes=0, code="found", ttl=None):
    return ip, at(minutes), code, names, ttl


def host(name, addresses, minutes=0, code="found", kind="A", ttl=None):
    return name, kind, at(minutes), code, addresses, ttl


PTRS = [
    ptr("1.0.0.1", ["H1.B.example."]), ptr("1.0.0.2", ["h2.other.example", "b.example.evil"]), ptr("1.0.0.3", ["h3.b.example"]), ptr("1.0.0.4", None, code="negative"), ptr("1.0.0.5", None, code="transient"),
    ptr("1.0.0.6", ["h6.b.example"]), ptr("1.0.0.7", ["crawl.example"]), ptr("1.0.0.8", ["notcrawl.example"]), ptr("1.0.0.9", ["h9.b.example", "h9b.b.example"]), ptr("2001:db8::1", ["v6.b.example"]),
    ptr("1.0.1.1", ["late.b.example"], 0), ptr("1.0.1.1", None, 30, "negative"), ptr("1.0.1.2", ["short.b.example"], 0, ttl=60), ptr("1.0.1.3", [], 0),
]
HOSTS = [
    host("h1.b.example.", ["1.0.0.1"]), host("h3.b.example", ["9.9.9.9"]), host("h3.b.example", None, code="negative", kind="AAAA"), host("h6.b.example", ["9.9.9.9"]),
    host("h6.b.example", None, code="transient", kind="AAAA"), host("crawl.example", ["1.0.0.7", "1.0.0.77"]), host("h9.b.example", ["9.9.9.9"]), host("h9.b.example", None, code="negative", kind="AAAA"),
    host("h9b.b.example", ["::ffff:1.0.0.9"], kind="AAAA"), host("v6.b.example", ["2001:0db8:0::0001"], kind="AAAA"), host("late.b.example", ["1.0.1.1"]), host("short.b.example", ["1.0.1.2"]),
]
CASES = {
    ("1.0.0.1", 5): "verified", ("1.0.0.2", 5): "spoofed", ("1.0.0.3", 5): "spoofed", ("1.0.0.4", 5): "spoofed", ("1.0.0.5", 5): "transient", ("1.0.0.6", 5): "transient",
    ("1.0.0.7", 5): "verified", ("1.0.0.8", 5): "spoofed", ("1.0.0.9", 5): "verified", ("2001:db8::1", 5): "verified", ("7.7.7.7", 5): "transient",
    ("1.0.0.1", -1): "transient", ("1.0.0.1", 59): "verified", ("1.0.0.1", 60): "transient", ("1.0.1.1", 29): "verified", ("1.0.1.1", 30): "spoofed", ("1.0.1.2", 0): "verified", ("1.0.1.2", 2): "transient", ("1.0.1.3", 1): "spoofed",
}


@pytest.fixture(scope="module")
def seen(spark):
    return spark.createDataFrame(PTRS, fcrdns.PTR), spark.createDataFrame(HOSTS, fcrdns.ADDRESSES)


def test_every_branch(spark, seen):
    asked = spark.createDataFrame([(ip, "b", at(m)) for ip, m in CASES] + [("1.0.0.1", "other", at(5)), ("1.0.0.1", "b", at(5))], "ip string, bot_id string, ts timestamp_ntz")
    got = {(r["ip"], int((r["ts"] - START).total_seconds() // 60)): r["outcome"] for r in fcrdns.outcomes(asked, *seen, [BOT]).collect()}
    assert got == CASES
    assert fcrdns.outcomes(asked, *seen, [BOT]).count() == len(CASES)


def test_in_enrichment(spark, seen):
    hit = lambda ip, m, ua="BBot": ("s", at(m), ip, "GET", "/", 200, 1, ua, "", 1.0, None, None, None)
    raw = spark.createDataFrame([hit("1.0.0.1", 5), hit("1.0.0.1", 70), hit("1.0.0.4", 5), hit("1.0.0.1", 5, "Firefox"), hit("not an ip", 5)], RAW)
    ranged = BOT | {"ip_source": "https://b.example/ranges"}
    ranges = spark.createDataFrame([("b", "08080800", "080808ff")], "bot_id string, first string, last string")
    rows = lambda **more: sorted((r["bot_ip"], r["ts"].minute, r["verification"]) for r in enrich(raw, Dimensions(ptr=seen[0], hosts=seen[1], **more), "k").filter(F.col("bot_id") == "b").collect())
    assert rows(bots=[BOT]) == [("1.0.0.1", 4, "verified"), ("1.0.0.1", 9, "unverified"), ("1.0.0.4", 4, "spoofed"), ("not an ip", 4, "unverified")]
    # where nothing is known of names, a published range decides
    assert rows(bots=[ranged], ranges=ranges) == [("1.0.0.1", 4, "verified"), ("1.0.0.1", 9, "spoofed"), ("1.0.0.4", 4, "spoofed"), ("not an ip", 4, "unverified")]
