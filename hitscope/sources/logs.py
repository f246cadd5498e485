"""Log lines to raw events. A line that cannot be read is counted, never an error.

Every reader takes a DataFrame with a column `line` and gives back the event's fields beside it; `ok` says whether all
required fields are there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hitscope.functions import logfields as n
from hitscope.functions.ip import let

FIELDS = ["ts", "ip", "method", "path", "status", "bytes", "ua", "referer", "response_ms"]
REQUIRED = ["ts", "ip", "method", "path", "status", "bytes"]

_QUOTED = r'"((?:[^"\\]|\\.)*)"'
_LINE = r"^(\S+) (\S+) (\S+) \[([^\]]+)\] " + _QUOTED + r" (\S+) (\S+)"


def _unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r'\\(["\\])', "$1")


#: Between the groups of a match, where a pattern is matched once for all of them; a line with it in is refused.
_MARK = "\x1e\x1f"


def _groups(x: Column, pattern: str, count: int) -> Column:
    """array<string> of a whole match's groups, or null."""
    found = F.split(F.regexp_replace(x, pattern, _MARK.join(f"${k}" for k in range(1, count + 1))), _MARK)
    return F.when(~F.contains(x, F.lit(_MARK)), let(found, lambda f: F.when(F.size(f) == count, f)))


def _clf(tail: str) -> Callable[[Column], list[tuple[str, Column]]]:
    """Columns that the fields of such a line are taken from, each made from those before."""
    pattern = _LINE + tail + r"\s*$"
    request = r"^(\S+) (\S+) HTTP/\d(?:\.\d)?$"
    return lambda line: [("_parts", _groups(line, pattern, 9)), ("_request", _groups(_unescaped(F.get("_parts", F.lit(4))), request, 2))]


def _found(of: dict[str, Column]) -> list[tuple[str, Column]]:
    """What is looked up in a line for its fields, as columns, so that each look-up is made once however often it is used."""
    return [(f"_at_{f}", column) for f, column in of.items()]


def _at(field: str) -> Column:
    return F.col(f"_at_{field}")


def _common(line: Column) -> list[Column]:
    part = lambda k: F.get("_parts", F.lit(k - 1))
    of = lambda k: F.get("_request", F.lit(k - 1))
    return [
        n.clf_time(part(4)).alias("ts"), part(1).alias("ip"), n.method(of(1)).alias("method"), n.path(of(2)).alias("path"), n.status(part(6)).alias("status"),
        n.size(part(7)).alias("bytes"), n.text(_unescaped(part(9))).alias("ua"), n.text(_unescaped(part(8))).alias("referer"), F.lit(None).cast("double").alias("response_ms"),
    ]


def apache(line: Column) -> list[Column]:
    """Common or combined format."""
    return _common(line)


def nginx_combined(line: Column) -> list[Column]:
    """Combined format, without an identity."""
    own = _common(line)
    return [F.when(F.get("_parts", F.lit(1)) == "-", own[0]).alias("ts"), *own[1:]]


def _json(line: Column, *names: str) -> Column:
    """The value of the first of the names that is present, even if that is null. _keys: the line's own names."""
    out: Column = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.array_contains("_keys", name), F.get_json_object(line, f"$['{name}']")).otherwise(out)
    return out


def _nginx_found(line: Column) -> list[tuple[str, Column]]:
    at = lambda *names: _json(line, *names)
    return [("_keys", F.json_object_keys(line)), *_found({
        "ts": at("time_iso8601", "time", "timestamp", "ts"), "ip": at("remote_addr", "ip"), "method": at("request_method", "method"), "path": at("request_uri", "uri", "path"),
        "status": at("status"), "bytes": at("body_bytes_sent", "bytes"), "ua": at("http_user_agent", "user_agent", "ua"), "referer": at("http_referer", "referer", "referrer"),
        "response_ms": at("request_time"),
    })]


def _fields(response_ms: Callable[[Column], Column]) -> list[Column]:
    """The event's fields from what was found."""
    return [
        n.event_time(_at("ts")).alias("ts"), _at("ip").alias("ip"), n.method(_at("method")).alias("method"), n.path(_at("path")).alias("path"), n.status(_at("status")).alias("status"),
        n.size(_at("bytes")).alias("bytes"), n.text(_at("ua")).alias("ua"), n.text(_at("referer")).alias("referer"), response_ms(_at("response_ms")).alias("response_ms"),
    ]


def nginx_json(line: Column) -> list[Column]:
    return _fields(n.seconds_to_millis)


def _caddy_found(line: Column) -> list[tuple[str, Column]]:
    at = lambda path: F.get_json_object(line, path)

    def header(name: str) -> Column:
        found = F.map_values(F.map_filter("_headers", lambda k, _: F.lower(k) == name))
        return F.get(F.get(found, F.lit(0)), F.lit(0))

    return [("_headers", F.from_json(at("$.request.headers"), "map<string,array<string>>")), *_found({
        "ts": at("$.ts"), "ip": F.coalesce(at("$.request.remote_ip"), at("$.request.client_ip")), "method": at("$.request.method"), "path": at("$.request.uri"), "status": at("$.status"),
        "bytes": at("$.size"), "ua": header("user-agent"), "referer": header("referer"), "response_ms": at("$.duration"),
    })]


def caddy_json(line: Column) -> list[Column]:
    return _fields(n.seconds_to_millis)


def _cloudflare_found(line: Column) -> list[tuple[str, Column]]:
    at = lambda name: F.get_json_object(line, f"$.{name}")
    return _found({
        "ts": at("EdgeStartTimestamp"), "ip": at("ClientIP"), "method": at("ClientRequestMethod"), "path": at("ClientRequestURI"), "status": at("EdgeResponseStatus"),
        "bytes": at("EdgeResponseBytes"), "ua": at("ClientRequestUserAgent"), "referer": at("ClientRequestReferer"), "response_ms": at("OriginResponseDurationMs"),
    })


def cloudflare_ndjson(line: Column) -> list[Column]:
    return _fields(n.millis)


def json_path(dotted: str) -> str:
    """a.b.0 to $['a']['b'][0]."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in dotted.split("."))


def jsonl(line: Column, field_map: dict[str, str]) -> list[Column]:
    """field_map: event field to dotted path; ts, ip, method, path and status must be mapped; bytes is 0 where unmapped."""
    missing = [f for f in REQUIRED if f != "bytes" and f not in field_map]
    if missing:
        raise ValueError(f"field map lacks {', '.join(missing)}")
    ts, ip, method, path, status, size, *rest = _fields(n.millis)
    return [ts, ip, method, path, status, size if "bytes" in field_map else F.lit(0).cast("bigint").alias("bytes"), *rest]


def _jsonl_found(line: Column, field_map: dict[str, str]) -> list[tuple[str, Column]]:
    return _found({f: F.get_json_object(line, json_path(field_map[f])) if f in field_map else F.lit(None).cast("string") for f in FIELDS})


FORMATS: dict[str, Callable[[Column], list[Column]]] = {
    "apache": apache, "nginx-combined": nginx_combined, "nginx-json": nginx_json, "caddy-json": caddy_json, "cloudflare-ndjson": cloudflare_ndjson,
}

#: What is taken from a line once, before its fields.
PREPARED: dict[str, Callable[[Column], list[tuple[str, Column]]]] = {
    "apache": _clf(rf"(?: {_QUOTED} {_QUOTED})?"), "nginx-combined": _clf(rf" {_QUOTED} {_QUOTED}"),
    "nginx-json": _nginx_found, "caddy-json": _caddy_found, "cloudflare-ndjson": _cloudflare_found,
}


def parse(lines: DataFrame, format: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """`line` to line, the event's FIELDS and ok; blank lines are left out."""
    if format != "jsonl" and format not in FORMATS:
        raise ValueError(f"unknown format {format!r}")
    bare = lines.withColumn("line", F.trim("line")).filter("line != ''")
    line = F.col("line")
    if format == "jsonl":
        fields = jsonl(line, field_map) if field_map else [F.lit(None).cast("string").alias(f) for f in FIELDS]
        prepared = _jsonl_found(line, field_map) if field_map else []
    else:
        fields, prepared = FORMATS[format](line), PREPARED[format](line)
    kept = [F.col(f"`{c}`") for c in bare.columns]
    for name, column in prepared:
        bare = bare.withColumn(name, column)
    # first as columns, each of which is computed once; a generator would compute what they share anew for each. Then as
    # rows of a generator, so that no condition on the fields is moved down into them, where it would repeat them
    made = bare.select(*kept, *[column.alias(f"_made_{f}") for f, column in zip(FIELDS, fields, strict=True)])
    got = made.select(*kept, F.inline(F.array(F.struct(*[F.col(f"_made_{f}").alias(f) for f in FIELDS]))))
    address = F.trim(F.coalesce(F.col("ip").cast("string"), F.lit("")))
    got = got.withColumn("ip", F.when(~address.isin("", "-"), address))
    ok = F.lit(True)
    for f in REQUIRED:
        ok = ok & F.col(f).isNotNull()
    return got.withColumn("ok", ok)


def events(parsed: DataFrame, site_id: str) -> DataFrame:
    """The readable lines as raw events of a site."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return parsed.filter("ok").select(F.lit(site_id).alias("site_id"), *FIELDS, none("country", "string"), none("asn", "bigint"), none("as_org", "string"))


@dataclass
class Counters:
    """What an import counted, known once its events have been used: every line read, events, and the rest, which were
    repeated, blank or not recognised."""

    lines: Observation
    kept: Observation

    def summary(self, batch: int = 5000) -> dict[str, Any]:
        read, events = self.lines.get["lines_read"], self.kept.get["events"]
        return {"lines_read": read, "events": events, "skipped": read - events, "batches": -(-events // batch), "recognised": not read or events > 0}

    def message(self) -> str:
        s = self.summary()
        base = f"{s['events']} events from {s['lines_read']} lines ({s['skipped']} skipped)"
        return base if s["recognised"] else f"{base}; no line was recognised: is this the log's format?"


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each line of a file once: lines of equal `_file` and `line`, known by 128 bits of hashes, are one.

    Only hashes are shuffled to find what repeats. Lines that do not repeat stay where they were read; the others, and
    only they, are gathered. Where few lines repeat, Spark broadcasts their hashes."""
    key = ["_h", "_g", "_p"]
    keyed = lines.select("*", F.xxhash64("line").alias("_h"), F.xxhash64(F.lit(7), F.col("line")).alias("_g"), F.xxhash64("_file").alias("_p"))
    repeated = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key)
    once = keyed.join(repeated, key, "left_anti")
    return once.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates(key)).drop(*key)


def read_log(spark: SparkSession, path: str, format: str, site_id: str, field_map: dict[str, str] | None = None) -> tuple[DataFrame, Counters]:
    """A file's or folder's events, each distinct line once per file, and counters filled as the result is used."""
    counted = Counters(Observation(), Observation())
    lines = spark.read.text(path).withColumnRenamed("value", "line").withColumn("_file", F.input_file_name())
    lines = lines.observe(counted.lines, F.count(F.lit(1)).alias("lines_read"))
    parsed = parse(distinct_lines(lines).drop("_file"), format, field_map)
    return events(parsed.observe(counted.kept, F.count_if("ok").alias("events")), site_id), counted


def read_log_stream(spark: SparkSession, folder: str, format: str, site_id: str, field_map: dict[str, str] | None = None, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream of events."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "line")
    return events(parse(lines, format, field_map), site_id)


def field_map_of(spec: str) -> dict[str, str]:
    """ "ts=when,ip=client.ip" as a field map."""
    out = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\w+)=([\w.\-]+)", part)
        if not m:
            raise ValueError(f"bad field map entry {part!r}")
        out[{"responseMs": "response_ms"}.get(m[1], m[1])] = m[2]
    return out
