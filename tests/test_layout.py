"""How events lie in files, what expires, and the texts and helpers that nothing else tests."""

import datetime as dt
import glob
import http.server
import re
import threading

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hitscope import textgen
from hitscope.functions import request
from hitscope.operators import enrich, sessions
from hitscope.plans import alerts, derived
from hitscope.sources import sinks


def events(spark, n):
    start = F.lit(dt.datetime(2024, 1, 1))
    return spark.range(n).select(
        F.concat(F.lit("site"), (F.col("id") % 5).cast("string")).alias("site_id"), F.when(F.col("id") % 10 < 7, "human").otherwise("ai_training").alias("actor_type"),
        (start + F.make_dt_interval(mins=(F.col("id") % 80_000).cast("int"))).cast("timestamp_ntz").alias("ts"), F.xxhash64("id").alias("session_id"),
    )


def test_writers_grow_with_the_data_and_files_are_even(spark, tmp_path):
    files = {}
    for n in (2_000, 20_000):
        sinks.write_events(events(spark, n), str(tmp_path / str(n)), rows_a_file=1_000)
        files[n] = glob.glob(f"{tmp_path}/{n}/month=*/*.parquet")
        assert sinks.read_events(spark, str(tmp_path / str(n))).count() == n
    assert len(files[2_000]) <= 5 and 20 <= len(files[20_000]) <= 26  # one more where a month's edge cuts a file
    rows = sorted(pq.ParquetFile(f).metadata.num_rows for f in files[20_000])
    assert rows[-1] <= 2_000


def test_readers_skip_files(spark, tmp_path):
    """Of one site's people in one hour, few files' statistics admit rows."""
    sinks.write_events(events(spark, 20_000), str(tmp_path), rows_a_file=500)
    admitted = []
    files = glob.glob(f"{tmp_path}/month=*/*.parquet")
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        of = lambda c: [meta.row_group(g).column(at[c]).statistics for g in range(meta.num_row_groups)]
        if any(s.min <= "site3" <= s.max for s in of("site_id")) and any(s.min <= "human" <= s.max for s in of("actor_type")) and any(s.min <= dt.datetime(2024, 1, 5, 1) and s.max >= dt.datetime(2024, 1, 5) for s in of("ts")):
            admitted.append(f)
    assert len(files) > 30 and 1 <= len(admitted) <= 4


def test_months_expire(spark, tmp_path):
    rows = spark.createDataFrame([("s", "human", dt.datetime(2023, m, 3), 1) for m in (1, 2, 3, 12)], "site_id string, actor_type string, ts timestamp_ntz, session_id long")
    sinks.write_events(rows, str(tmp_path / "e"))
    assert sinks.expire_events(spark, str(tmp_path / "e"), dt.datetime(2024, 3, 15)) == ["202301"]
    assert sinks.expire_events(spark, str(tmp_path / "e"), dt.datetime(2024, 3, 15)) == []
    assert sinks.read_events(spark, str(tmp_path / "e")).count() == 3


def test_texts():
    assert "https://shop.example/" in textgen.llms_txt(" https://user@Shop.Example./path?q ") and textgen.llms_txt("").startswith("# example.com\n")
    unit = textgen.unit_text({"command": "/bin/tail", "path": '/var/log/a "b" %d.log', "format": "apache", "other": 1})
    assert 'ExecStart="/bin/tail" "/var/log/a \\"b\\" %%d.log" "apache"\n' in unit


def test_blocks_in_documents():
    document = {"prefixes": [{"ipv4Prefix": "1.2.3.0/24"}, {"ipv6Prefix": "2001:DB8::/32"}], "more": ["9.9.9.9", "not one", 5, None, {"x": "1.2.3.0/24"}], "created": "2024-01-01T00:00:00"}
    assert sinks.cidrs_in(document) == ["1.2.3.0/24", "2001:DB8::/32", "9.9.9.9"]


def test_posting_alerts():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(self.rfile.read(int(self.headers["content-length"])))
            self.send_response(500 if len(asked) == 1 else 204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        send = alerts.post_json(f"http://127.0.0.1:{server.server_port}/", timeout=5)
        assert send({"rule": "spike"}) and asked == [b'{"rule": "spike"}'] * 2
    finally:
        server.shutdown()
        server.server_close()
    assert not alerts.post_json(f"http://127.0.0.1:{server.server_port}/", timeout=1, retries=0)({})


def test_no_task_sorts_more_as_events_grow(spark, tmp_path, monkeypatch):
    """A file's writer and a task that finds sessions hold a bounded number of rows: more events are more tasks."""
    assert sinks.ROWS_A_FILE <= 250_000
    spark.range(3_000).select(
        F.col("id").alias("event_id"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"), (F.col("id") % 500).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    whole = sorted(map(tuple, derived.enriched(spark, str(tmp_path)).collect()), key=str)
    monkeypatch.setattr(derived, "EVENTS_A_TASK", 100)
    assert sorted(map(tuple, derived.enriched(spark, str(tmp_path)).collect()), key=str) == whole
    started = sessions.with_session_start(derived.raw(spark, str(tmp_path)), ["site_id", "ip", "ua"], parts=30)
    assert started.rdd.getNumPartitions() == 30


def test_path_groups_and_referers_are_as_by_segment_and_event(spark):
    long, uuid = "x" * 33, "3F2504e0-4f89-11d3-9a0c-0305e82c3301"
    paths = ["/", "", "//", "/a/", "/12/34/5/x", "/12a", f"/{uuid}/", f"/{uuid}0", "/deadbeef", "/deadbee", "/DEADBEEF1/x/", f"/{long}", f"/{long[1:]}", f"/a/{long}/{long}", "12", "/1\n2/3", "/\U0001f600" + "y" * 32]
    def one(p):
        p = p[:-1] if p.endswith("/") else p
        dynamic = lambda s: re.fullmatch(r"[0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{8,}", s) or len(s) > 32
        return "/".join(":id" if dynamic(s) else s for s in p.split("/")) or "/"
    got = {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", request.path_group(F.col("p"))).collect()}
    assert got == {p: one(p) for p in paths}
    urls = ["https://ChatGPT.com/x", "chatgpt.com", "https://b\u00fccher.example/", "", None, "https://www.bing.com/chat?q=1", "https://www.bing.com/"]
    looked = {r["referer"]: (r["_origin"], r["_sent"]) for r in enrich.referers(spark.createDataFrame([(u,) for u in urls * 2], "referer string")).collect()}
    assert looked == {
        urls[0]: ("https://chatgpt.com", "chatgpt"), urls[1]: ("", "chatgpt"), urls[2]: ("https://xn--bcher-kva.example", ""), urls[5]: ("https://www.bing.com", "copilot"), urls[6]: ("https://www.bing.com", ""),
    }
