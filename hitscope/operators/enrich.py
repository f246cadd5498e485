"""Raw request events to enriched ones: one row in, one row out."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitscope import registry
from hitscope.functions import request
from hitscope.functions.agent_index import classified
from hitscope.functions.ip import ip_key
from hitscope.operators import fcrdns, ranges
from hitscope.operators.sessions import with_id_of_start, with_session_start

RAW = "site_id string, ts timestamp_ntz, ip string, method string, path string, status int, bytes bigint, ua string, referer string, response_ms double, country string, asn bigint, as_org string"

COLUMNS = [
    "site_id", "ts", "ip_hash", "bot_ip", "method", "path", "path_group", "query", "status", "bytes", "response_ms", "ua", "actor_type", "bot_id", "operator",
    "verification", "referer", "ai_referral", "topic_id", "session_id", "ingest_source", "country", "asn", "as_org",
]

#: Upper bounds of a raw event's fields. Fixed values.
LIMITS = {"ip": 64, "method": 16, "path": 4096, "ua": 4096, "referer": 4096, "as_org": 256}


def first_issue() -> Column:
    """The first field of a raw event that is not valid, or null. Optional fields may be null."""
    size = F.char_length
    wrong = [
        ("ts", F.col("ts").isNull()),
        ("ip", F.coalesce(~size("ip").between(1, LIMITS["ip"]), F.lit(True))),
        ("method", F.coalesce(~size("method").between(1, LIMITS["method"]), F.lit(True))),
        ("path", F.coalesce(~size("path").between(1, LIMITS["path"]), F.lit(True))),
        ("status", F.coalesce(~F.col("status").between(0, 999), F.lit(True))),
        ("bytes", F.coalesce(~F.col("bytes").between(0, 2**53 - 1), F.lit(False))),
        ("ua", F.coalesce(size("ua") > LIMITS["ua"], F.lit(False))),
        ("referer", F.coalesce(size("referer") > LIMITS["referer"], F.lit(False))),
        ("response_ms", F.coalesce(~F.col("response_ms").between(0, 3_600_000), F.lit(False))),
        ("country", F.coalesce(size("country") != 2, F.lit(False))),
        ("asn", F.coalesce(~F.col("asn").between(0, 2**32 - 1), F.lit(False))),
        ("as_org", F.coalesce(size("as_org") > LIMITS["as_org"], F.lit(False))),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in wrong])


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid events, and the others with their first issue."""
    judged = raw.withColumn("issue", first_issue())
    return judged.filter("issue is null").drop("issue"), judged.filter("issue is not null")


@dataclass
class Dimensions:
    """What enrichment looks up. ranges: (bot_id, first, last); networks: (first, last, asn, country, as_org);
    rdns: (ip, bot_id, outcome in verified, spoofed, transient), judged elsewhere, as executors ask no name server; or
    ptr and hosts, observations of names and addresses, from which `fcrdns` judges each hit at its time."""

    bots: list[dict[str, Any]] = field(default_factory=registry.entries)
    ranges: DataFrame | None = None
    networks: DataFrame | None = None
    rdns: DataFrame | None = None
    ptr: DataFrame | None = None
    hosts: DataFrame | None = None


def verification(bot_id: Column, key: Column, in_range: Column, has_ranges: Column, bots: list[dict[str, Any]], dns: Column) -> Column:
    """na, verified, unverified or spoofed.

    Addresses in a published range are verified; else, reverse DNS decides if the vendor has suffixes; where that gives
    nothing, published and loaded ranges make a stranger spoofed, and missing ones leave it unverified.
    """
    methods = {e["bot_id"]: (bool(e["ip_source"]), bool(e["rdns_suffixes"])) for e in bots if e["ip_source"] or e["rdns_suffixes"]}
    any_method, by_dns, by_range = bot_id.isin(*methods), bot_id.isin(*[b for b, m in methods.items() if m[1]]), bot_id.isin(*[b for b, m in methods.items() if m[0]])
    provisional = F.when(by_range & has_ranges, "spoofed").otherwise("unverified")
    return (
        F.when((bot_id == "") | ~any_method, "na").when(key.isNull(), "unverified").when(by_range & in_range, "verified")
        .when(by_dns & dns.isin("verified", "spoofed"), dns).otherwise(provisional)
    )


def agents(raw: DataFrame, bots: list[dict[str, Any]]) -> DataFrame:
    """(_ua, actor_type, bot_id, operator) for each distinct agent of raw events, null as ''."""
    return classified(raw.select(F.coalesce("ua", F.lit("")).alias("_ua")).distinct(), bots, "_ua")


def addresses(raw: DataFrame, dims: Dimensions) -> DataFrame:
    """(ip, _key, _in, _asn, _country, _org) for each distinct address of raw events; _in: the bots in whose ranges it is."""
    each = raw.select("ip").distinct().withColumn("_key", ip_key(F.col("ip")))
    if dims.ranges is not None:
        held = ranges.matches(each, dims.ranges, "_key").groupBy("_key").agg(F.collect_set("bot_id").alias("_in"))
        each = each.join(held, "_key", "left")
    else:
        each = each.withColumn("_in", F.lit(None).cast("array<string>"))
    if dims.networks is not None:
        each = each.withColumn("_net", ip_key(F.col("ip"), mapped=False))
        announced = dims.networks.select("first", "last", F.col("asn").alias("_asn"), F.col("country").alias("_country"), F.col("as_org").alias("_org"))
        # number 0 says that nobody announces the range
        found = ranges.latest(each.select("_net"), announced, "_net", ["_asn", "_country", "_org"]).filter("_asn != 0")
        return each.join(found, "_net", "left").drop("_net")
    return each.withColumn("_asn", F.lit(None).cast("bigint")).withColumn("_country", F.lit(None).cast("string")).withColumn("_org", F.lit(None).cast("string"))


def referers(raw: DataFrame) -> DataFrame:
    """(referer, _origin, _sent) for each distinct referer of raw events that is not empty; _sent: the assistant whose pages it is one of."""
    each = raw.select("referer").filter("referer != ''").distinct()
    scripts = F.col("referer").rlike(r"[^\x00-\x7F]")
    sent = request.referral_by_host(F.col("referer")).alias("_sent")
    plain = each.filter(~scripts).select("referer", request.referer_origin(F.col("referer")).alias("_origin"), sent)
    return plain.unionByName(each.filter(scripts).select("referer", request.idna_origin(F.col("referer")).alias("_origin"), sent))


def enrich(raw: DataFrame, dims: Dimensions, secret: str, source: str = "api", parts: int | None = None) -> DataFrame:
    """Valid raw events (RAW) to COLUMNS. Absent values are '' or 0, never null.

    Agents, addresses and referers are looked up once each, whatever the number of events; Spark
    broadcasts what was found where it is small, and else joins by shuffle. A column session_start (of a stream's
    state) gives the sessions' starts; without it they are found among these events, in `parts` tasks if given.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = raw.withColumn("_ua", text("ua")).withColumn("ip_hash", request.visitor_hash(F.col("ip"), F.col("ts"), secret))
    if "session_start" not in raw.columns:
        # first, so that the work on the columns comes after this shuffle and has its partitions
        one = with_session_start(one, ["site_id", "ip_hash", "_ua"], parts=parts)
    one = one.join(agents(raw, dims.bots), "_ua", "left").join(addresses(raw, dims), "ip", "left")
    published = [r[0] for r in dims.ranges.select("bot_id").distinct().collect()] if dims.ranges is not None else []  # at most the registry's bots
    if dims.ptr is not None and dims.hosts is not None:
        judged = fcrdns.outcomes(one, dims.ptr, dims.hosts, dims.bots).withColumnRenamed("outcome", "_dns")
        one = one.join(judged, ["ip", "bot_id", "ts"], "left")
    elif dims.rdns is not None:
        one = one.join(dims.rdns.select("ip", "bot_id", F.col("outcome").alias("_dns")), ["ip", "bot_id"], "left")
    else:
        one = one.withColumn("_dns", F.lit(""))
    one = one.join(referers(raw), "referer", "left")
    is_bot = F.col("actor_type") != "human"
    in_range, has_ranges = F.coalesce(F.array_contains("_in", F.col("bot_id")), F.lit(False)), F.col("bot_id").isin(published) if published else F.lit(False)
    wide = one.select(
        "site_id", "ts", "ip_hash", "session_start", F.when(is_bot, F.col("ip")).otherwise("").alias("bot_ip"),
        request.upper(F.col("method")).alias("method"), request.pathname(F.col("path")).alias("path"), request.path_group(request.pathname(F.col("path"))).alias("path_group"),
        F.lit("").alias("query"), F.col("status").cast("int").alias("status"), F.coalesce(F.col("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
        F.floor(F.coalesce(F.col("response_ms"), F.lit(0.0)) + 0.5).cast("bigint").alias("response_ms"), F.col("_ua").alias("ua"), "actor_type", "bot_id", "operator",
        verification(F.col("bot_id"), F.col("_key"), in_range, has_ranges, dims.bots, F.coalesce("_dns", F.lit(""))).alias("verification"),
        F.coalesce("_origin", F.lit("")).alias("referer"),
        F.when(is_bot, "").when(F.coalesce("_sent", F.lit("")) != "", F.col("_sent")).otherwise(F.coalesce(request.referral_by_utm(request.query(F.col("path"))), F.lit(""))).alias("ai_referral"),
        F.lit("").alias("topic_id"), F.lit(source).alias("ingest_source"),
        F.when(text("country") != "", F.col("country")).otherwise(text("_country")).alias("country"),
        F.when(F.coalesce("asn", F.lit(0)) != 0, F.col("asn")).otherwise(F.coalesce("_asn", F.lit(0))).cast("bigint").alias("asn"),
        F.when(text("as_org") != "", F.col("as_org")).otherwise(text("_org")).alias("as_org"),
    )
    return with_id_of_start(wide).select(*COLUMNS)
