"""Sources, sinks, lookups and alerts that no registered query reaches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hitscope import registry, textgen
from hitscope.functions import ip, request
from hitscope.functions.agents import classify
from hitscope.operators import ranges
from hitscope.operators.enrich import COLUMNS, RAW, Dimensions, enrich
from hitscope.plans import alerts, display, panels
from hitscope.sources import logs, registry_documents, sinks

NOW = dt.datetime(2024, 3, 1, 12)


def hit(minutes, ip="192.0.2.1", ua="GPTBot/1.2", path="/a", status=200, referer=""):
    return ("s", NOW - dt.timedelta(minutes=minutes), ip, "GET", path, status, 10, ua, referer, 1.0, None, None, None)


@pytest.fixture(scope="module")
def events(spark):
    rows = [hit(i, path=f"/p{i % 3}") for i in range(40)] + [hit(3, ua="Chrome/120", referer="https://bücher.example/x"), hit(5, ip="2001:db8::5")]
    return enrich(spark.createDataFrame(rows, RAW), Dimensions(), "k").cache()


def networks(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string, asn long")
    return df.select(ip.ip_key(F.col("a")).alias("first"), ip.ip_key(F.col("b")).alias("last"), "asn", F.lit("XX").alias("country"), F.lit("org").alias("as_org"))


def test_last_start_decides(spark):
    nets = networks(spark, [
        ("10.0.0.0", "10.255.255.255", 1), ("10.1.0.0", "10.1.0.255", 2), ("10.1.0.0", "10.1.0.15", 3), ("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", 4),
        ("2001:db8:1::", "2001:db8:1::f", 5), ("::", "1fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", 6),
    ])
    at = {"10.0.9.9": 1, "10.1.0.20": 2, "10.1.0.3": 2, "10.1.2.3": None, "9.9.9.9": None, "11.0.0.0": None, "2001:db8:0:7::1": 4, "2001:db8:1::5": 5, "2001:db8:1::10": None, "::1": 6, "bad": None}
    keys = spark.createDataFrame([(a,) for a in at], "ip string").withColumn("key", ip.ip_key(F.col("ip")))
    found = keys.join(ranges.latest(keys, nets, "key", ["asn"]), "key", "left").collect()
    assert {r["ip"]: r["asn"] for r in found} == at
    raw = spark.createDataFrame([hit(0, ip="::ffff:10.0.9.9"), hit(0, ip="10.0.9.9")], RAW)
    assert sorted(r["asn"] for r in enrich(raw, Dimensions(networks=nets), "k").collect()) == [0, 1]


def test_network_dump(spark, tmp_path):
    lines = ["10.1.0.0\t10.1.0.255\t64500\tUS\tOne", "10.0.0.0\t10.0.0.255\t64501\tDE\tTwo\r", "bad\trow", "10.2.0.0\t2001:db8::\t1\t\t", "10.3.0.0\t10.3.0.1\t4294967296\t\t", "2001:db8::\t2001:db8::f\t7\tFR\tSix", "10.4.0.0\t10.4.0.9\t0\t\t"]
    (tmp_path / "dump.tsv").write_bytes("\n".join(lines).encode())
    got = {(r["asn"], r["country"], r["as_org"]) for r in sinks.read_networks(spark, str(tmp_path / "dump.tsv")).collect()}
    assert got == {(64500, "US", "One"), (64501, "DE", "Two"), (7, "FR", "Six"), (0, "", "")}


def test_addresses(spark):
    cases = {"1.2.3.4": "01020304", "01.2.3.4": None, "::ffff:1.2.3.4": "01020304", "2001:DB8::1": "20010db8" + "0" * 23 + "1", "1::2::3": None, "": None, "12345::": None}
    got = spark.createDataFrame([(k,) for k in cases], "a string").select("a", ip.ip_key(F.col("a")).alias("k")).collect()
    assert {r["a"]: r["k"] for r in got} == cases
    blocks = {"10.0.0.0/8": ("0a000000", "0affffff"), "10.1.2.3/32": ("0a010203", "0a010203"), "10.1.2.3/33": None, "2001:db8::/33": ("20010db8" + "0" * 24, "20010db87" + "f" * 23), "x/8": None}
    got = spark.createDataFrame([(k,) for k in blocks], "c string").select("c", ip.cidr_range(F.col("c")).alias("r")).collect()
    assert {r["c"]: r["r"] and tuple(r["r"]) for r in got} == blocks


def test_agents_by_stage(spark):
    entry = lambda b, a, p: {"bot_id": b, "operator": b, "actor_type": a, "ua_patterns": [p], "ip_source": None, "rdns_suffixes": [], "docs_url": None}
    bots = [entry("strong", "ai_training", "StrongBot"), entry("rx", "seo_tool", r"^Rx\/[0-9]+"), entry("weak", "monitoring", "Zyx"), entry("vague", "ai_training", "Spider"), entry("bad", "social", "(?<x")]
    cases = {"a strongbot/1": "strong", "Rx/12": "rx", "rx/12": "", "has zyx in": "weak", "Cubot Android": "", "my spider 2": "", "curl/8": "", "Firefox": "", "": ""}
    kinds = {"Cubot Android": "human", "my spider 2": "other_bot", "curl/8": "other_bot", "Firefox": "human", "": "other_bot", "rx/12": "human"}
    got = spark.createDataFrame([(k,) for k in cases], "ua string").select("ua", classify(F.col("ua"), bots).alias("c")).collect()
    assert {r["ua"]: r["c"]["bot_id"] for r in got} == cases
    assert all(r["c"]["actor_type"] == kinds[r["ua"]] for r in got if r["ua"] in kinds)


def test_reverse_dns_decides(spark):
    bots = [{"bot_id": "b", "operator": "o", "actor_type": "search_engine", "ua_patterns": ["BBot"], "ip_source": None, "rdns_suffixes": [".b.example"], "docs_url": None}]
    seen = spark.createDataFrame([("1.1.1.1", "b", "verified"), ("1.1.1.2", "b", "spoofed"), ("1.1.1.3", "b", "transient")], "ip string, bot_id string, outcome string")
    raw = spark.createDataFrame([hit(0, ip=f"1.1.1.{k}", ua="BBot") for k in (1, 2, 3, 4)], RAW)
    got = {r["bot_ip"][-1]: r["verification"] for r in enrich(raw, Dimensions(bots=bots, rdns=seen), "k").collect()}
    assert got == {"1": "verified", "2": "spoofed", "3": "unverified", "4": "unverified"}


def test_scripts_of_hosts(events):
    assert events.columns == COLUMNS
    assert events.filter("referer != ''").collect()[0]["referer"] == "https://xn--bcher-kva.example"


def test_import_counts(spark, tmp_path):
    line = '1.2.3.4 - - [10/Jun/2024:12:30:00 +0000] "GET /b HTTP/1.1" 200 1'
    (tmp_path / "a.log").write_text("\n".join([line, line, line, "", "bad"]) + "\n")
    rows, counted = logs.read_log(spark, str(tmp_path / "a.log"), "nginx-combined", "s")
    assert rows.count() == 0 or rows.count() == 1
    assert len(logs.read_log(spark, str(tmp_path / "a.log"), "apache", "s")[0].collect()) == 1
    rows, counted = logs.read_log(spark, str(tmp_path / "a.log"), "apache", "s")
    rows.collect()
    assert counted.summary() == {"lines_read": 5, "events": 1, "skipped": 4, "batches": 1, "recognised": True}
    rows, counted = logs.read_log(spark, str(tmp_path / "a.log"), "caddy-json", "s")
    rows.collect()
    assert not counted.summary()["recognised"] and "no line was recognised" in counted.message()


def test_csv_cells():
    assert sinks.to_csv([{"a": True, "b": False, "c": 1.0, "d": 1.5}]) == "a,b,c,d\ntrue,false,1,1.5\n"


def test_delivery():
    calls, waits = [], []

    def send(chunk):
        calls.append(len(chunk))
        if len(calls) < 3:
            raise sinks.Retry(7.0 if len(calls) == 2 else None)
        return len(chunk)

    assert sinks.deliver([{}] * 4, send, wait=waits.append) == 4
    assert calls == [4, 4, 4] and waits == [0.25, 7.0]
    with pytest.raises(OSError):
        sinks.deliver([{}], lambda c: (_ for _ in ()).throw(OSError("down")), tries=2, wait=waits.append)


def test_push_from_executors(spark):
    def send(chunk):
        if any(r["id"] == 13 for r in chunk):
            raise ValueError("refused")
        return len(chunk)

    got = sinks.push(spark.range(20).repartition(1).orderBy("id").coalesce(1), send, chunk=5)
    assert (got["delivered"], got["failed"]) == (10, 10) and "refused" in got["error"]


def test_backup_and_restore(spark, events, tmp_path):
    manifest = sinks.backup(events, str(tmp_path / "b"))
    assert manifest["rows"] == 42
    back, rolled = sinks.restore(spark, str(tmp_path / "b"), str(tmp_path / "t"))
    assert back.count() == 42 and rolled["daily_bot_stats"].agg(F.sum("hits")).first()[0] == 42
    events.limit(3).write.mode("overwrite").parquet(str(tmp_path / "b" / "events"))
    with pytest.raises(ValueError):
        sinks.restore(spark, str(tmp_path / "b"))


def test_guards(events):
    p = panels.Panels(events, NOW)
    for wrong in (lambda: p.top_pages(24, 101), lambda: p.top_pages(24, search="x" * 201), lambda: p.kpis(0), lambda: p.kpis(8761), lambda: p.landing_pages(366)):
        with pytest.raises(ValueError):
            wrong()
    rows, more = p.bots(24, most=1)
    assert rows.count() == 1 and not more
    assert "ai_training" in p.hourly_wide(24).columns


def test_display(spark):
    numbers = {999: "999", 1234: "1.2K", 12345: "12K", 1_234_567: "1.2M"}
    df = spark.createDataFrame([(k,) for k in numbers], "n long")
    assert {r[0]: r[1] for r in df.select("n", display.short_number(F.col("n"))).collect()} == numbers
    ages = {0: "now", 5: "5m ago", 180: "3h ago", 2 * 1440: "2d ago", -9: "now"}
    df = spark.createDataFrame([(m, NOW - dt.timedelta(minutes=m)) for m in ages], "m long, ts timestamp_ntz")
    assert {r[0]: r[1] for r in df.select("m", display.age(F.col("ts"), F.lit(NOW).cast("timestamp_ntz"))).collect()} == ages
    daily = spark.createDataFrame([("/a", "1", 5), ("/a", "2", 1), ("/b", "1", 9)], "page string, date string, hits long")
    assert display.default_pages(daily) == ["/b", "/a"] and display.toggled(["/a"], "/a") == [] and display.toggled(["/a"], "/b", 1) == ["/a"]
    assert [tuple(r) for r in display.series(daily, ["/a"]).collect()] == [("/a", ["1", "2"], [5, 1])]


def test_registry_documents(spark, tmp_path):
    (tmp_path / "robots.json").write_text(json.dumps({"NewBot": {"operator": "[New & Co](https://new.example)", "function": "AI Search Crawler"}}))
    (tmp_path / "snapshot.json").write_text(json.dumps([{"pattern": "Otherbot\\/", "url": "https://www.other.example/x", "tags": ["monitoring"]}]))
    (tmp_path / "own.json").write_text(json.dumps([{"bot_id": "newbot", "operator": "own", "actor_type": "ai_fetcher", "ua_patterns": ["NewBot-User"], "rdns_suffixes": [".n.example"]}]))
    got = registry_documents.build(spark, f"{tmp_path}/robots.json", f"{tmp_path}/missing.json", f"{tmp_path}/own.json", {"crawlers": f"{tmp_path}/snapshot.json"})
    rows = {r["bot_id"]: r for r in got.collect()}
    assert (rows["newbot"]["operator"], rows["newbot"]["actor_type"], rows["newbot"]["ua_patterns"]) == ("own", "ai_fetcher", ["NewBot-User", "NewBot"])
    assert (rows["otherbot"]["operator"], rows["otherbot"]["actor_type"]) == ("other", "monitoring")
    with pytest.raises(ValueError):
        registry_documents.document(spark, f"{tmp_path}/missing.json")


def test_alert_round(spark, events):
    """A subject is told once within the cooldown, one refused delivery is tried again, a broken site leaves others alone."""
    from hitscope.operators import rollups

    p = panels.Panels(events, NOW, {n: rollups.build(events, n) for n in rollups.KEYS})
    asked, answer = [], [False, True]

    def deliver(event):
        asked.append((event["rule"], event["site"], event["subject"]))
        return answer[min(len(asked), 2) - 1]

    r = alerts.Round(deliver, rules=["spoof", "nonsense", "spike"], factor=0.0, minutes=60)
    busy = events.unionByName(events.withColumn("ts", F.col("ts") - F.expr("interval 3 hours")))
    sites = {"bad": None, "a": panels.Panels(busy, NOW, p.rollups)}
    assert r.tick(sites, NOW) == [] and asked == [("spike", "a", "ai")]
    assert [e["subject"] for e in r.tick(sites, NOW)] == ["ai"]
    assert r.tick(sites, NOW + dt.timedelta(hours=1)) == [] and len(asked) == 2
    assert any(f.startswith("nonsense|a") for f in r.failures) and any("|bad" in f for f in r.failures)
    r.running = True
    assert r.tick(sites, NOW + dt.timedelta(days=1)) == []
    old = {"x": (NOW - dt.timedelta(hours=7)).isoformat(), "y": NOW.isoformat(), "z": "?"}
    assert alerts.prune(old, NOW, dt.timedelta(hours=6)) == {"y": NOW.isoformat()}


def test_no_visitor_address_stays(events):
    people = events.filter("actor_type = 'human'").collect()
    assert people and all(r["bot_ip"] == "" and r["query"] == "" for r in people)
    assert request.UTM_SOURCES and textgen.CATEGORIES and registry.entries()
