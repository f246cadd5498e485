"""Queries over the derived request log, each with SQL written from the semantics for another engine."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitscope import registry, textgen
from hitscope.functions import ip, request
from hitscope.functions.agent_index import classified
from hitscope.functions.agents import classify
from hitscope.operators import fcrdns, ranges, rollups, segmented, sessions, sketches
from hitscope.plans import alerts, all_sites, derived, explore, panels
from hitscope.sources import logs

Query = Callable[[SparkSession, str], DataFrame]

HOURS, DAYS = 168, 20
EARLY = dt.datetime(2024, 1, 1, 6)


def _plain(df: DataFrame) -> DataFrame:
    """Hash-typed numbers and dates as text."""
    return df.select(*[F.col(c).cast("string").alias(c) if t.startswith("decimal(20") or t == "date" else F.col(c) for c, t in df.dtypes])


def _panel(f: Callable[[panels.Panels], DataFrame], site: str | None = None, as_of: dt.datetime = derived.AS_OF) -> Query:
    return lambda spark, sf_dir: _plain(f(derived.panels(spark, sf_dir, site, as_of)))


def _raw(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain(f(derived.raw(spark, sf_dir)))


# the other engine's view of the log

_AGENTS = ", ".join(
    f"('{token}', '{actor}', '{bot}', '{operator}', {ranged})"
    for token, actor, bot, operator, ranged in [
        ("GPTBot", "ai_training", "gptbot", "openai", True), ("OAI-SearchBot", "ai_search", "oai-searchbot", "openai", True), ("ChatGPT-User", "ai_fetcher", "chatgpt-user", "openai", True),
        ("Googlebot", "search_engine", "googlebot", "google", True), ("ClaudeBot", "ai_training", "claudebot", "anthropic", True),
        ("PerplexityBot", "ai_search", "perplexitybot", "perplexity", True), ("Bytespider", "ai_training", "bytespider", "bytedance", False),
        ("curl/", "other_bot", "", "", False), ("AhrefsBot", "seo_tool", "ahrefsbot", "ahrefs", True), ("Claude-User", "ai_fetcher", "claude-user", "anthropic", True),
        ("CCBot", "ai_training", "ccbot", "common-crawl", True), ("facebookexternalhit", "social", "facebookexternalhit", "meta", False),
        ("bingbot", "search_engine", "bingbot", "microsoft", True), ("UptimeRobot", "monitoring", "uptimerobot", "uptimerobot", False),
    ]
)
_GROUP = """case when rtrim(split_part(path, '?', 1), '/') = '' then '/' else array_to_string(list_transform(string_split(
  case when ends_with(split_part(path, '?', 1), '/') then left(split_part(path, '?', 1), -1) else split_part(path, '?', 1) end, '/'),
  lambda s: case when regexp_full_match(s, '[0-9]+') or regexp_full_match(lower(s), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')
    or regexp_full_match(lower(s), '[0-9a-f]{8,}') or length(s) > 32 then ':id' else s end), '/') end"""
_REFERRAL = """case when referer like 'https://chatgpt.com%' or referer = 'chatgpt.com' then 'chatgpt' when referer like '%perplexity.ai%' then 'perplexity'
  when referer like '%claude.ai%' then 'claude' when referer like '%gemini.google.com%' then 'gemini' when referer like '%bing.com/chat%' then 'copilot'
  when path like '%utm_source=chatgpt.com%' then 'chatgpt' when path like '%utm_source=perplexity%' then 'perplexity' else '' end"""
_ORIGIN = "case when referer like 'https://%' then 'https://' || split_part(substr(referer, 9), '/', 1) else '' end"
_RAW = f"raw as materialized ({derived.raw_sql('ts + to_seconds(2 * i)')})"
_NET = """case when ip like '198.51.100.%' and {o} <= 127 then {us} when ip like '203.0.113.%' and {o} <= 63 then {nl} when ip like '192.0.2.%' and {o} <= 99 then {de}
  when ip like '192.0.2.%' and {o} <= 149 then {fr} else {none} end"""


def _net(us: str, nl: str, de: str, fr: str, none: str) -> str:
    return _NET.format(o="cast(split_part(ip, '.', 4) as int)", us=us, nl=nl, de=de, fr=fr, none=none)


_EVENTS = f"""{_RAW},
agents(token, actor_type, bot_id, operator, ranged) as (values {_AGENTS}),
e1 as (select site_id, ts, cast(('0x' || left(sha256('{derived.SECRET} ' || strftime(ts, '%Y-%m-%d') || ' ' || ip), 16))::ubigint as varchar) as ip_hash,
    case when a.token is null then '' else ip end as bot_ip, upper(method) as method, split_part(path, '?', 1) as path, {_GROUP} as path_group, status, bytes,
    cast(floor(response_ms + 0.5) as bigint) as response_ms, ua, coalesce(a.actor_type, 'human') as actor_type, coalesce(a.bot_id, '') as bot_id, coalesce(a.operator, '') as operator,
    case when not coalesce(ranged, false) then 'na' when ip like '198.51.100.%' then 'verified' else 'spoofed' end as verification,
    {_ORIGIN} as referer, case when a.token is null then {_REFERRAL} else '' end as ai_referral, 'api' as ingest_source,
    {_net("'US'", "'NL'", "'DE'", "''", "''")} as country, {_net("64500", "64501", "64502", "0", "0")}::bigint as asn,
    {_net("'Example Hosting'", "'Forge Net'", "'Home ISP'", "''", "''")} as as_org
  from raw left join agents a on contains(ua, a.token)),
e2 as (select *, case when ts - lag(ts) over (partition by site_id, ip_hash, ua order by ts) <= interval 30 minutes then 0 else 1 end as fresh from e1),
e3 as (select *, sum(fresh) over (partition by site_id, ip_hash, ua order by ts rows unbounded preceding) as k from e2),
events_enriched as materialized (select * exclude (fresh, k), cast(('0x' || left(sha256(site_id || '|' || ip_hash || '|' || ua || ' ' ||
    (epoch_us(first_value(ts) over (partition by site_id, ip_hash, ua, k order by ts)) // 1000)), 16))::ubigint as varchar) as session_id from e3)"""
_AS_OF = "timestamp '2024-01-31 00:00:00'"
_W1 = f"w as (select * from events_enriched where ts > {_AS_OF} - interval {HOURS} hours)"
_W2 = f"w as (select * from events_enriched where ts > {_AS_OF} - interval {2 * HOURS} hours and ts <= {_AS_OF} - interval {HOURS} hours)"
_W3 = f"w as (select * from events_enriched where ts >= {_AS_OF} - interval {DAYS} days)"
_AI, _REAL = "actor_type like 'ai%'", "verification <> 'spoofed'"
_CLICK = "actor_type = 'human' and ai_referral <> ''"
_ASSET = r"regexp_matches(path_group, '(?i)\.(css|js|mjs|map|json|xml|txt|png|jpe?g|gif|webp|avif|svg|ico|woff2?|ttf|otf|eot|mp3|mp4|webm|pdf|zip|gz)$')"
_CONTENT = f"not {_ASSET} and not starts_with(path_group, '/.well-known/')"
_DATES = f"cast(ts as date) > date '2024-01-31' - {DAYS}"


def _q(body: str, window: str = "") -> str:
    return f"with {_EVENTS}{', ' + window if window else ''} {body}"


_KPIS = f"""select count(*) filter ({_AI} and {_REAL}) as ai_hits, count(*) filter ({_AI} and verification = 'verified') as ai_verified,
 count(*) filter ({_AI} and verification in ('unverified', 'na')) as ai_unverified, count(distinct bot_id) filter (bot_id <> '' and {_REAL}) as unique_bots,
 count(*) filter (verification = 'verified') as verified, count(*) filter (verification = 'spoofed') as spoofed, count(*) filter (ai_referral <> '') as ai_referrals,
 count(*) filter (actor_type <> 'human' and status >= 400 and {_REAL}) as bot_errors from w"""
_PAGES_DAILY = f"""d as (select path_group as page, cast(ts as date) as date, count(*) as hits from events_enriched where {_AI} and {_REAL} and {_DATES} group by all),
 top as (select page, sum(hits) as total from d group by 1 order by 2 desc, 1 limit 30)"""
_CRAWLS = f"crawls as (select operator, count(*) as crawls from events_enriched where {_AI} and {_REAL} and operator <> '' and {_DATES} group by 1)"
_CLICKS = f"clicks as (select ai_referral as source, count(*) as clicks from events_enriched where ai_referral <> '' and {_DATES} group by 1)"
_MAP = ", ".join(f"('{a}', '{b}')" for a, b in panels.ASSISTANTS.items())
_VENDORS = f"""{_CRAWLS}, {_CLICKS}, m(operator, source) as (values {_MAP}),
 v as (select coalesce(c.operator, k.source) as vendor, coalesce(crawls, 0)::bigint as crawls, coalesce(clicks, 0)::bigint as clicks, c.operator is null or m.source is not null as has_assistant
  from crawls c left join m on c.operator = m.operator full join clicks k on k.source = m.source)"""


def _rollup(name: str) -> Query:
    return lambda spark, sf_dir: _plain(rollups.build(derived.stored(spark, sf_dir), name))


def _distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts by site and day, and by site, and whether the sketches' estimates are within 5 % of them."""
    events = derived.stored(spark, sf_dir)
    daily = sketches.build(events)
    told = sketches.counts(daily).unionByName(sketches.counts(sketches.merge(daily, ["site_id"])).withColumn("date", F.lit(None).cast("date")))
    told = told.select(F.col("site_id").alias("_site"), F.col("date").alias("_date"), *[F.col(c).alias(f"_{c}") for c in sketches.COUNTED])
    both = sketches.exact(events).join(told, (F.col("site_id") == F.col("_site")) & F.col("date").eqNullSafe(F.col("_date")))
    ok = [(F.abs(F.col(f"_{c}") - F.col(c)) <= 0.05 * F.col(c)).alias(f"{c}_ok") for c in sketches.COUNTED]
    return _plain(both.select("site_id", "date", *sketches.COUNTED, *ok))


def _robots_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a registry made of parts: an agent of some category for each brand and size, a second one, in capitals, for some."""
    brand, size = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_size")
    each = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(brand, F.lit("-"), size.cast("string")).alias("token"), size.alias("n")).distinct()
    kind = F.element_at(F.array(*map(F.lit, ("ai_training", "ai_search", "ai_fetcher", "seo_tool"))), (F.col("n") % 4 + 1).cast("int"))
    first = each.select(F.lower("token").alias("bot_id"), kind.alias("actor_type"), F.array(F.concat("token", F.lit("/"))).alias("ua_patterns"))
    second = each.filter("n % 5 = 0").select(F.concat(F.lit("z-"), F.lower("token")).alias("bot_id"), F.lit("ai_training").alias("actor_type"), F.array(F.upper("token")).alias("ua_patterns"))
    return textgen.robots_tokens(first.unionByName(second), {"training": "deny", "search": "allow", "fetch": "allow"})


def _rollup_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves built apart and merged, against the whole: no row."""
    events = derived.stored(spark, sf_dir)
    out = None
    for name in rollups.KEYS:
        halves = [rollups.build(events.filter(F.col("bytes") % 2 == k), name) for k in (0, 1)]
        d = rollups.difference(rollups.merge(*halves, name=name), events, name).groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("rollup"), "rows")
        out = d if out is None else out.unionByName(d)
    return out


def _merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address intervals made of the orders table, overlapping and adjacent ones joined."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lo = (F.col("o_orderkey") * 37) % 100003 + F.col("o_orderkey") % 7
    as_key = lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 8, "0")
    rows = orders.select((F.col("o_custkey") % 5).cast("string").alias("owner"), as_key(lo).alias("first"), as_key(lo + F.col("o_orderkey") % 5).alias("last"))
    return ranges.merged(rows, ["owner"])


def _one_owner_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as intervals of one owner."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lo = (F.col("o_orderkey") * 37) % 1000003
    as_key = lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 8, "0")
    return segmented.merged(orders.select(F.lit("all").alias("owner"), as_key(lo).alias("first"), as_key(lo + F.col("o_orderkey") % 9).alias("last")), ["owner"])


def _one_key_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all events, as hits of one automaton."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("one").alias("key"))
    return segmented.with_session_start(e, ["key"]).select("event_id", "session_start")


def _ip_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived.raw(spark, sf_dir).select("ip").distinct().withColumn("key", ip.ip_key(F.col("ip")))
    nets = derived.dimensions(spark).networks
    found = ranges.latest(raw, nets, "key", ["asn", "country", "as_org"]).filter("asn != 0")
    return raw.join(found, "key", "left").select("ip", "key", F.coalesce("asn", F.lit(0)).alias("asn"), F.coalesce("country", F.lit("")).alias("country"), F.coalesce("as_org", F.lit("")).alias("as_org"))


#: Networks that nest, of both families: first, last, number.
NESTED = [
    ("10.0.0.0", "10.0.255.255", 1), ("10.0.1.0", "10.0.1.7", 2), ("10.0.2.0", "10.0.2.255", 0), ("10.0.3.16", "10.0.3.31", 3),
    ("2001:db8::", "2001:db8:3:ffff:ffff:ffff:ffff:ffff", 4), ("2001:db8:1::", "2001:db8:1::f", 5), ("2001:db8:5::10", "2001:db8:5::1f", 6),
]


def _nested(spark: SparkSession, sf_dir: str, family: int) -> DataFrame:
    """Addresses made from the events, looked up in networks that nest."""
    four = F.concat(F.lit("10.0."), (F.col("event_id") % 5).cast("string"), F.lit("."), (F.col("user_id") % 40).cast("string"))
    six = F.concat(F.lit("2001:DB8:"), F.lower(F.hex(F.col("event_id") % 7)), F.lit("::"), F.lower(F.hex(F.col("user_id") % 40)))
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select((four if family == 4 else six).alias("ip")).distinct().withColumn("key", ip.ip_key(F.col("ip")))
    nets = spark.createDataFrame(NESTED, "a string, b string, asn long").select(ip.ip_key(F.col("a")).alias("first"), ip.ip_key(F.col("b")).alias("last"), "asn")
    found = ranges.latest(asked, nets, "key", ["asn"]).filter("asn != 0")
    return asked.join(found, "key", "left").select("ip", "key", F.coalesce("asn", F.lit(0)).alias("asn"))


def _cidr_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("10."), (F.col("o_orderkey") % 256).cast("string"), F.lit("."), (F.col("o_custkey") % 256).cast("string"), F.lit(".77/"), (F.col("o_orderkey") % 33).cast("string"))
    return ranges.from_cidrs(spark.read.parquet(f"{sf_dir}/orders.parquet").select(made.alias("cidr")).distinct()).select("cidr", "first", "last")


def _log(format: str) -> Query:
    """The log written as lines of a format, with two that are refused, and read again."""

    def lines(raw: DataFrame) -> DataFrame:
        c = F.col
        if format in ("apache", "nginx-combined"):
            line = F.format_string('%s - - [%s +0100] "%s %s HTTP/1.1" %s %s "%s" "%s"', c("ip"), F.date_format(c("ts") + F.expr("interval 1 hour"), "dd/MMM/yyyy:HH:mm:ss"), c("method"), c("path"), c("status"), c("bytes"), c("referer"), c("ua"))
        else:
            iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
            seconds = F.unix_timestamp(c("ts").cast("timestamp"))
            fields = {
                "nginx-json": F.struct(iso.alias("time_iso8601"), c("ip").alias("remote_addr"), c("method").alias("request_method"), c("path").alias("request_uri"), "status", c("bytes").alias("body_bytes_sent"), c("ua").alias("http_user_agent"), c("referer").alias("http_referer")),
                "caddy-json": F.struct(seconds.alias("ts"), F.struct(c("ip").alias("remote_ip"), "method", c("path").alias("uri"), F.struct(F.array("ua").alias("User-Agent"), F.array("referer").alias("Referer")).alias("headers")).alias("request"), "status", c("bytes").alias("size")),
                "cloudflare-ndjson": F.struct((seconds * 1_000_000_000).alias("EdgeStartTimestamp"), c("ip").alias("ClientIP"), c("method").alias("ClientRequestMethod"), F.concat(F.lit("https://h.example"), c("path")).alias("ClientRequestURI"), c("status").alias("EdgeResponseStatus"), c("bytes").alias("EdgeResponseBytes"), c("ua").alias("ClientRequestUserAgent"), c("referer").alias("ClientRequestReferer")),
                "jsonl": F.struct(iso.alias("when"), F.struct("ip").alias("client"), F.struct("method", "path").alias("http"), "status", c("bytes").alias("n"), "ua", "referer"),
            }
            line = F.to_json(fields[format])
        return raw.select(line.alias("line")).unionByName(raw.sparkSession.createDataFrame([("neither this",), ('{"status": 200}',)], "line string"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = logs.field_map_of("ts=when,ip=client.ip,method=http.method,path=http.path,status=status,bytes=n,ua=ua,referer=referer") if format == "jsonl" else None
        raw = derived.raw(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
        got = logs.events(logs.parse(lines(raw), format, wanted), "s")
        return got.groupBy("ts", "ip", "method", "path", "status", "bytes", "ua", "referer").agg(F.count(F.lit(1)).alias("n"))

    return run


def _registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table's brands and types as three ranked sources of entries."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")

    def source(k: int, actor: str) -> DataFrame:
        rows = part.filter(F.col("p_partkey") % 3 == k).groupBy(registry.slug(F.concat(F.lit("Bot "), F.col("p_brand"))).alias("bot_id")).agg(F.min("p_type").alias("operator"), F.min("p_name").alias("p"))
        none = F.lit(None).cast("string")
        return rows.select("bot_id", F.when(F.lit(k != 2), F.col("operator")).alias("operator"), F.lit(actor).alias("actor_type"), F.array("p").alias("ua_patterns"), none.alias("ip_source"), F.array(F.lit(f".s{k}.net")).alias("rdns_suffixes"), none.alias("docs_url"))

    got = registry.compile_registry(source(0, "other_bot"), source(1, "ai_training"), source(2, "ai_search"))
    return got.select("bot_id", "operator", "actor_type", F.array_join("ua_patterns", "|").alias("patterns"), F.array_join("rdns_suffixes", "|").alias("suffixes"))


def _page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin and path group of the pages' own addresses."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/?#]*", ""), "#.*$", "")
    return pages.select("page_id", request.referer_origin(F.col("url")).alias("origin"), request.path_group(request.pathname(path)).alias("path_group"))


def _explore(metric: str, dimension: str, filters: dict[str, str] | None = None) -> Query:
    return _panel(lambda p: explore.explore(p.hours(HOURS), metric, dimension, filters))


_METRIC = {
    "hits": "count(*)", "bots": "count(distinct bot_id) filter (bot_id <> '')", "pages": "count(distinct path_group)", "sessions": "count(distinct session_id)",
    "bytes": "sum(bytes)", "errors": "count(*) filter (status >= 400)",
}
_DIMENSION = {d: d for d in explore.DIMENSIONS} | {
    "bot_id": "if(bot_id = '', '(none)', bot_id)", "operator": "if(operator = '', '(none)', operator)", "country": "if(country = '', '(unknown)', country)",
    "as_org": "if(as_org = '', '(unknown)', as_org)", "ai_referral": "if(ai_referral = '', '(none)', ai_referral)", "status": "(status // 100) || 'xx'",
    "hour": "hour(ts)::varchar", "weekday": "isodow(ts)::varchar",
}
EXPLORED = [(m, d) for m in explore.METRICS for d in explore.DIMENSIONS]


def _early(minutes: int, f: Callable[[panels.Panels, int], DataFrame]) -> Query:
    return _panel(lambda p: f(p, minutes), as_of=EARLY)


_EARLY = "timestamp '2024-01-01 06:00:00'"

#: Kinds of actors in the derived log.
_KINDS = ["ai_fetcher", "ai_search", "ai_training", "human", "monitoring", "other_bot", "search_engine", "seo_tool", "social"]


def _hourly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = derived.panels(spark, sf_dir).hourly_wide(HOURS)
    return wide.select("t", *[F.col(k) if k in wide.columns else F.lit(None).cast("bigint").alias(k) for k in _KINDS])


def long_registry(parts: DataFrame) -> list[dict[str, Any]]:
    """A registry of a token for each brand and size of parts and a pattern for each brand: at most some 1,300 entries, whatever the number of parts."""
    entry = lambda bot, kind, owner, pattern: {"bot_id": bot, "operator": owner, "actor_type": kind, "ua_patterns": [pattern]}
    sizes = sorted(tuple(r) for r in parts.select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("b"), "p_size").distinct().collect())
    tokens = [entry(f"{b}-{n}".lower(), "ai_training" if n % 2 else "seo_tool", b.lower(), f"{b}-{n}") for b, n in sizes]
    return tokens + [entry(f"{b}fetch".lower(), "ai_fetcher", "unknown", rf"^{b}Fetch\/[0-9]+") for b in sorted({b for b, _ in sizes})]


def part_agents(parts: DataFrame) -> DataFrame:
    """(p_partkey, ua): crawlers, fetchers, browsers and nameless bots."""
    brand, key, size = F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    ua = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Mozilla/5.0 (compatible; "), brand, F.lit("-"), size, F.lit("; v"), key, F.lit("; +http://x.example/"), brand, F.lit("-1)")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(brand, F.lit("Fetch/"), key, F.lit(" (compatible)")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/"), key, F.lit(".0 Safari/537.36")))
        .otherwise(F.concat(F.lit("acme-"), F.lower("p_name"), F.lit("-crawler/"), key))
    )
    return parts.select("p_partkey", ua.alias("ua"))


def _long_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return classified(part_agents(parts), long_registry(parts)).select("p_partkey", "ua", "actor_type", "bot_id", "operator")


def _fcrdns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits judged by names and addresses that other events say were seen."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("user_id") % 50).cast("string").alias("k"))
    e = e.withColumn("ip", F.concat(F.lit("10.0.0."), "k")).withColumn("host", F.concat(F.lit("crawl-"), "k", F.lit(".googlebot.com")))
    when = lambda modulus, *found: F.coalesce(*[F.when(F.col("event_id") % modulus == i, x) for i, x in enumerate(found)])
    lit, none = F.lit, F.lit(None)
    names = when(5, none, none, F.array(F.concat("host", lit("."))), F.array(lit("x.evil.example"), F.upper("host")), F.array(lit("googlebot.com.evil.example")))
    ptr = e.filter("event_id % 7 = 0").select("ip", F.col("ts").alias("seen"), when(5, lit("negative"), lit("transient"), lit("found"), lit("found"), lit("found")).alias("code"), names.alias("names"), none.cast("int").alias("ttl"))
    addresses = when(4, none, none, F.array(F.concat(lit("::ffff:"), "ip")), F.array(lit("10.9.9.9")))
    hosts = e.filter("event_id % 7 in (1, 2)").select(
        "host", F.when(F.col("event_id") % 7 == 1, "A").otherwise("AAAA").alias("kind"), F.col("ts").alias("seen"),
        when(4, lit("transient"), lit("negative"), lit("found"), lit("found")).alias("code"), addresses.alias("addresses"), lit(7200).alias("ttl"),
    )
    asked = e.filter("event_id % 7 > 2").select("ip", lit("googlebot").alias("bot_id"), "ts")
    return fcrdns.outcomes(asked, ptr, hosts, registry.entries()).select("ip", "ts", "outcome")


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the panel of bots says that it shows all of them, by the number it may show."""
    p = derived.panels(spark, sf_dir)
    said = [p.bots_flagged(HOURS, most).agg(F.lit(most).alias("most"), F.count(F.lit(1)).alias("shown"), F.coalesce(F.bool_or("more"), F.lit(False)).alias("more")) for most in (3, 100)]
    return said[0].unionByName(said[1])


QUERIES: dict[str, Query] = {
    "enriched_events": lambda s, d: _plain(derived.enriched(s, d)).drop("query", "topic_id"),
    "kpis": _panel(lambda p: p.kpis(HOURS)),
    "kpis_prev": _panel(lambda p: p.kpis_before(HOURS)),
    "hourly_by_actor": _panel(lambda p: p.hourly(HOURS)),
    "top_bots": _panel(lambda p: p.top_bots(HOURS)),
    "top_pages": _panel(lambda p: p.top_pages(HOURS)),
    "top_pages_search": _panel(lambda p: p.top_pages(HOURS, search="BLOG")),
    "referrals": _panel(lambda p: p.referrals(HOURS)),
    "recent_feed": _panel(lambda p: p.recent(HOURS)),
    "sites": _panel(lambda p: p.sites()),
    "bot_hourly": _panel(lambda p: p.bot_detail("gptbot", HOURS)["hourly"]),
    "bot_paths": _panel(lambda p: p.bot_detail("gptbot", HOURS)["paths"]),
    "bot_status": _panel(lambda p: p.bot_detail("gptbot", HOURS)["status"]),
    "bot_sources": _panel(lambda p: p.bot_detail("gptbot", HOURS)["sources"]),
    "bot_countries": _panel(lambda p: p.bot_detail("gptbot", HOURS)["countries"]),
    "spoofed_by_bot": _panel(lambda p: p.spoofed_by_bot(HOURS)),
    "spoofed_sources": _panel(lambda p: p.spoofed_sources(HOURS)),
    "ai_landing_pages": _panel(lambda p: p.landing_pages(DAYS)),
    "pages_daily": _panel(lambda p: p.pages_daily(DAYS)),
    "pages_daily_dense": _panel(lambda p: p.pages_daily_dense(DAYS)),
    "retrieved_pages": _panel(lambda p: p.retrieved_pages(DAYS)),
    "infra_hits": _panel(lambda p: p.infra_hits(DAYS)),
    "clicks_by_source": _panel(lambda p: p.clicks_by_source(DAYS)),
    "crawls_by_operator": _panel(lambda p: p.crawls_by_operator(DAYS)),
    "retrieval_feed": _panel(lambda p: p.retrieval_feed(DAYS)),
    "crawls_by_operator_rollup": _panel(lambda p: p.crawls_by_operator(DAYS, rollup=True)),
    "clicks_by_source_rollup": _panel(lambda p: p.clicks_by_source(DAYS, rollup=True)),
    "take_vs_give": _panel(lambda p: p.take_vs_give(DAYS)),
    "vendor_verdicts": _panel(lambda p: panels.verdicts(p.take_vs_give(DAYS))),
    "broken_pages": _panel(lambda p: p.broken_pages(DAYS)),
    "blind_spots": _panel(lambda p: p.blind_spots(DAYS), site="site_1"),
    "blind_spots_failopen": _panel(lambda p: p.blind_spots(DAYS), site="site_2"),
    "alert_spike": _panel(lambda p: alerts.spike(p, 0.5), as_of=dt.datetime(2024, 1, 20, 12)),
    "alert_new_bot": _early(180, alerts.new_bots),
    "alert_spoof": _panel(lambda p: alerts.spoofed(p, 3 * 24 * 60)),
    "alerts_all_sites": _panel(lambda p: all_sites.found(p, 180, 0.5), as_of=EARLY),
    "alert_broken": _panel(lambda p: alerts.broken_citations(p, 3 * 24 * 60)),
    "path_group": _raw(lambda r: r.select("path").distinct().select("path", request.path_group(request.pathname(F.col("path"))).alias("path_group"))),
    "referral_class": _raw(lambda r: r.select("referer", "path").distinct().select("referer", "path", request.referral(F.col("referer"), request.query(F.col("path"))).alias("source"))),
    "ua_class": _raw(lambda r: r.select("ua").distinct().withColumn("c", classify(F.col("ua"), registry.entries())).select("ua", "c.*")),
    "ip_network": _ip_network,
    "ip_network_nested": lambda s, d: _nested(s, d, 4),
    "ip_network_v6": lambda s, d: _nested(s, d, 6),
    "cidr_ends": _cidr_ends,
    "hourly_wide": _hourly_wide,
    "bots_truncated": _truncated,
    "ua_class_registry": _long_registry,
    "fcrdns": _fcrdns,
    "ip_verify": lambda s, d: derived.stored(s, d).filter("bot_id != ''").groupBy("bot_id", "bot_ip", "verification").agg(F.count(F.lit(1)).alias("hits")),
    "merged_ranges": _merged_ranges,
    "merged_ranges_one_owner": _one_owner_ranges,
    "sessions_one_key": _one_key_sessions,
    "sessions": lambda s, d: _plain(derived.stored(s, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))),
    "daily_bot_stats": _rollup("daily_bot_stats"),
    "daily_page_stats": _rollup("daily_page_stats"),
    "daily_referrals": _rollup("daily_referrals"),
    "daily_page_ai_stats": _rollup("daily_page_ai_stats"),
    "rollup_diff": _rollup_diff,
    "distinct_sketches": _distinct_sketches,
    "registry_merge": _registry_merge,
    "robots_tokens": _robots_tokens,
    "page_urls": _page_urls,
    "user_sessions": lambda s, d: sessions.with_session_start(s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts"), ["user_id"]).select("event_id", "session_start"),
} | {f"log_{f.replace('-', '_')}": _log(f) for f in ("apache", "nginx-combined", "nginx-json", "caddy-json", "cloudflare-ndjson", "jsonl")} | {f"explore_{m}_{d}": _explore(m, d) for m, d in EXPLORED} | {"explore_filtered": _explore("hits", "path_group", {"operator": "openai", "verification": "verified", "country": ""})}

SQL: dict[str, str] = {
    "enriched_events": _q("select * from events_enriched"),
    "kpis": _q(_KPIS, _W1),
    "kpis_prev": _q(_KPIS, _W2),
    "hourly_by_actor": _q(f"select date_trunc('hour', ts)::timestamp as t, actor_type, count(*) as hits from w where {_REAL} group by all", _W1),
    "top_bots": _q("select bot_id, arg_max(operator, ts) as operator, arg_max(actor_type, ts) as actor_type, count(*) as hits, count(distinct path_group) as pages, count(*) filter (verification = 'spoofed') as spoofed, count(*) filter (status >= 400) as errors, max(ts) as last_seen from w where bot_id <> '' group by 1 order by hits desc, bot_id limit 10", _W1),
    "top_pages": _q(f"select path_group, count(*) filter ({_AI} and {_REAL}) as ai_hits, count(*) filter (actor_type = 'ai_training' and {_REAL}) as training_hits, count(*) filter (actor_type = 'ai_search' and {_REAL}) as search_hits, count(*) filter (actor_type = 'ai_fetcher' and {_REAL}) as fetcher_hits, count(distinct bot_id) filter ({_AI} and {_REAL} and bot_id <> '') as ai_bots, count(*) as hits, max(ts) filter ({_AI} and {_REAL}) as last_ai_hit from w group by 1 having ai_hits > 0 order by ai_hits desc, hits desc, path_group limit 100", _W1),
    "referrals": _q("select ai_referral as source, count(*) as hits from w where ai_referral <> '' group by 1", _W1),
    "recent_feed": _q("select ts, actor_type, bot_id, operator, verification, path, status, ai_referral from w where actor_type <> 'human' or ai_referral <> '' order by ts desc, path, bot_id, status, actor_type, verification, ai_referral limit 30", _W1),
    "sites": _q("select distinct site_id from events_enriched"),
    "bot_hourly": _q("select date_trunc('hour', ts)::timestamp as t, count(*) as hits from w where bot_id = 'gptbot' group by 1", _W1),
    "bot_paths": _q("select path_group, count(*) as hits, count(*) filter (status >= 400) as errors, max(ts) as last_seen from w where bot_id = 'gptbot' group by 1 order by hits desc, path_group limit 20", _W1),
    "bot_status": _q("select (status // 100) || 'xx' as status_class, count(*) as hits from w where bot_id = 'gptbot' group by 1", _W1),
    "bot_sources": _q("select bot_ip, arg_max(country, ts) as country, arg_max(as_org, ts) as as_org, arg_max(verification, ts) as verification, count(*) as hits from w where bot_id = 'gptbot' and bot_ip <> '' group by 1 order by hits desc, bot_ip limit 20", _W1),
    "bot_countries": _q("select country, count(*) as hits from w where bot_id = 'gptbot' and country <> '' group by 1 order by hits desc, country limit 10", _W1),
    "spoofed_by_bot": _q("select bot_id, count(*) as hits, count(distinct bot_ip) as ips from w where verification = 'spoofed' group by 1", _W1),
    "spoofed_sources": _q("select bot_ip as ip, arg_max(bot_id, (ts, bot_id, country, as_org)) as bot_id, arg_max(country, (ts, bot_id, country, as_org)) as country, arg_max(as_org, (ts, bot_id, country, as_org)) as as_org, count(distinct bot_id) as identities, count(*) as hits, max(ts) as last_seen from w where verification = 'spoofed' and bot_ip <> '' group by 1 order by hits desc, ip limit 50", _W1),
    "ai_landing_pages": _q(f"select path_group as page, count(*) filter (actor_type = 'ai_training') as training, count(*) filter (actor_type = 'ai_search') as search, count(*) filter (actor_type = 'ai_fetcher') as \"fetch\", count(*) filter ({_CLICK}) as clicked from w where {_REAL} group by 1 having clicked > 0 order by clicked desc, training + search + \"fetch\" desc, page limit 50", _W3),
    "pages_daily": _q("select page, date::varchar as date, hits from d semi join top using (page)", _PAGES_DAILY),
    "pages_daily_dense": _q(f"select page, date::varchar as date, total::bigint as total, coalesce(hits, 0)::bigint as hits from top cross join (select (date '2024-01-31' - r::int)::date as date from range(0, {DAYS}) t(r)) left join d using (page, date)", _PAGES_DAILY),
    "retrieved_pages": _q(f"select path_group as page, count(*) filter (actor_type = 'ai_fetcher') as fetched, count(*) filter (actor_type = 'ai_search') as surfaced, count(*) filter ({_CLICK}) as clicked, max(ts) as last_cited from w where {_REAL} and {_CONTENT} and (actor_type in ('ai_fetcher', 'ai_search') or ({_CLICK})) group by 1 order by fetched + clicked desc, surfaced desc, page limit 50", _W3),
    "infra_hits": _q(f"select path_group as page, count(*) as hits from w where {_REAL} and not ({_CONTENT}) and actor_type in ('ai_fetcher', 'ai_search') group by 1 order by hits desc, page limit 5", _W3),
    "clicks_by_source": _q(f"select ai_referral as source, count(*) as clicks from w where {_CLICK} group by 1", _W3),
    "crawls_by_operator": _q(f"select operator, count(*) as crawls from w where {_AI} and {_REAL} and operator <> '' group by 1", _W3),
    "retrieval_feed": _q(f"select ts, bot_id, operator, actor_type, path, status from w where {_REAL} and actor_type in ('ai_fetcher', 'ai_search') order by ts desc, path, bot_id, status limit 30", _W3),
    "crawls_by_operator_rollup": _q("select * from crawls", _CRAWLS),
    "clicks_by_source_rollup": _q("select * from clicks", _CLICKS),
    "take_vs_give": _q("select *, case when crawls > 0 then round(clicks / crawls, 9) end as ratio from v", _VENDORS),
    "vendor_verdicts": _q("select vendor, crawls, clicks, f as floor, case when not has_assistant then 'only-takes' when clicks > 0 and crawls = 0 then 'sends-without-crawling' when clicks > 0 then 'sends' when f is null or crawls < f then 'not-enough' else 'sent-nobody' end as verdict, case when clicks > 0 and crawls > 0 then round(crawls / clicks, 9) end as per_visitor from v cross join (select case when b > 0 and b < 1 then ceil(ln(0.5) / ln(1 - b))::bigint end as f from (select max(clicks / crawls) filter (crawls > 0 and clicks > 0) as b from v))", _VENDORS),
    "broken_pages": _q(f"select path_group as page, count(*) filter (status >= 400) as ai_errors, arg_max(status, (ts, status)) filter (status >= 400) as last_status, max(ts) filter (status >= 400) as last_hit, bool_or(status < 400) as ever_ok from w where {_AI} and {_REAL} and status not in (401, 403) group by 1 having ai_errors > 0 order by ai_errors desc, page limit 50", _W3),
    "alert_spike": _q(f"select * from (select count(*) filter (ts > t - interval 1 hour) as last_hour, round(count(*) filter (ts <= t - interval 1 hour) / 167, 9) as avg_hour from (select *, timestamp '2024-01-20 12:00:00' as t from events_enriched) where {_AI} and {_REAL} and ts <= t and ts > t - interval 7 days) where last_hour >= 20 and avg_hour > 0 and last_hour > 0.5 * avg_hour"),
    "alert_new_bot": _q(f"select bot_id, count(*) as hits from w where ts >= {_EARLY} - interval 180 minutes and {_REAL} and bot_id <> '' and bot_id not in (select bot_id from w where ts < {_EARLY} - interval 180 minutes) and exists (from w where ts < {_EARLY} - interval 180 minutes) group by 1 order by hits desc, bot_id limit 20", f"w as (select * from events_enriched where ts <= {_EARLY} and ts >= {_EARLY} - interval 30 days)"),
    "alert_spoof": _q(f"select bot_id, count(*) as hits from events_enriched where verification = 'spoofed' and ts > {_AS_OF} - interval 3 days and ts <= {_AS_OF} group by 1 order by hits desc, bot_id limit 20"),
    "alert_broken": _q(f"select path_group, count(*) as errors from events_enriched where actor_type in ('ai_fetcher', 'ai_search') and {_REAL} and status >= 400 and status not in (401, 403) and ts > {_AS_OF} - interval 3 days and ts <= {_AS_OF} and path_group in (select path_group from events_enriched where actor_type in ('ai_fetcher', 'ai_search') and {_REAL} and cast(ts as date) > date '2024-01-31' - 31 group by 1 having count(*) > count(*) filter (status >= 400)) group by 1 order by errors desc, path_group limit 20"),
    "path_group": f"with {_RAW} select distinct path, {_GROUP} as path_group from raw",
    "referral_class": f"with {_RAW} select distinct referer, path, {_REFERRAL} as source from raw",
    "ua_class": f"with {_RAW}, agents(token, actor_type, bot_id, operator, ranged) as (values {_AGENTS}) select distinct ua, coalesce(actor_type, 'human') as actor_type, coalesce(bot_id, '') as bot_id, coalesce(operator, '') as operator from raw left join agents on contains(ua, token)",
    "ip_network": f"with {_RAW} select distinct ip, array_to_string(list_transform(string_split(ip, '.'), lambda b: lpad(lower(to_hex(b::int)), 2, '0')), '') as key, {_net('64500', '64501', '64502', '0', '0')}::bigint as asn, {_net(chr(39) + 'US' + chr(39), chr(39) + 'NL' + chr(39), chr(39) + 'DE' + chr(39), chr(39) * 2, chr(39) * 2)} as country, {_net(chr(39) + 'Example Hosting' + chr(39), chr(39) + 'Forge Net' + chr(39), chr(39) + 'Home ISP' + chr(39), chr(39) * 2, chr(39) * 2)} as as_org from raw",
    "ip_verify": _q("select bot_id, bot_ip, verification, count(*) as hits from events_enriched where bot_id <> '' group by all"),
    "merged_ranges": "with r as (select (o_custkey % 5)::varchar as owner, (o_orderkey * 37) % 100003 + o_orderkey % 7 as lo, (o_orderkey * 37) % 100003 + o_orderkey % 7 + o_orderkey % 5 as hi from orders), p as (select owner, unnest(range(lo, hi + 1)) as x from r), u as (select distinct owner, x from p), g as (select owner, x, x - row_number() over (partition by owner order by x) as k from u) select owner, lpad(lower(to_hex(min(x))), 8, '0') as first, lpad(lower(to_hex(max(x))), 8, '0') as last from g group by owner, k",
    "sessions": _q("select session_id, count(*) as hits, min(ts) as first_ts, max(ts) as last_ts from events_enriched group by 1"),
    "daily_bot_stats": _q("select site_id, (ts::date)::varchar as date, actor_type, bot_id, operator, verification, count(*) as hits, sum(bytes)::bigint as bytes, count(*) filter (status >= 400) as errors from events_enriched group by all"),
    "daily_page_stats": _q("select site_id, (ts::date)::varchar as date, path_group, actor_type, operator, count(*) as hits, count(*) filter (status >= 400) as errors from events_enriched group by all"),
    "daily_referrals": _q("select site_id, (ts::date)::varchar as date, ai_referral, path_group, count(*) as hits from events_enriched where ai_referral <> '' group by all"),
    "daily_page_ai_stats": _q(f"select site_id, (ts::date)::varchar as date, path_group, actor_type, verification, count(*) as hits, count(*) filter (status >= 400) as errors from events_enriched where {_AI} group by all"),
    "rollup_diff": "select * from (values ('daily_bot_stats', 0::bigint), ('daily_page_stats', 0), ('daily_referrals', 0), ('daily_page_ai_stats', 0)) t(rollup, rows)",
    "robots_tokens": """with p as (select distinct replace(p_brand, '#', '') || '-' || p_size as token, p_size as n from part),
      e as (select lower(token) as bot, token, n % 4 as kind from p where n % 4 <> 3 union all select 'z-' || lower(token), upper(token), 0 from p where n % 5 = 0)
      select arg_min(token, bot) as token, bool_or(kind = 0) as denied from e group by lower(token)""",
    "user_sessions": "with a as (select event_id, user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as f from events), b as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) as k from a) select event_id, min(ts) over (partition by user_id, k) as session_start from b",
    "explore_filtered": _q("select path_group as key, count(*) as value from w where operator = 'openai' and verification = 'verified' group by 1 order by 2 desc, 1 limit 50", _W1),
} | {f"explore_{m}_{d}": _q(f"select {_DIMENSION[d]} as key, cast({_METRIC[m]} as bigint) as value from w group by 1 order by 2 desc, 1 limit 50", _W1) for m, d in EXPLORED}
SQL["top_pages_search"] = SQL["top_pages"].replace("from w group by", "from w where path_group ilike '%blog%' group by")
_WRITTEN = f"""with {_RAW} select date_trunc('second', ts)::timestamp as ts, ip, upper(method) as method, path, status, bytes, ua, referer, count(*) as n from raw group by all"""
SQL |= {f"log_{f}": _WRITTEN for f in ("apache", "nginx_combined", "nginx_json", "caddy_json", "cloudflare_ndjson", "jsonl")}
SQL["hourly_wide"] = _q("select date_trunc('hour', ts)::timestamp as t, " + ", ".join(f"nullif(count(*) filter (actor_type = '{k}'), 0) as {k}" for k in _KINDS) + f" from w where {_REAL} group by 1", _W1)
SQL["ua_class_registry"] = """with p as (select p_partkey, replace(p_brand, '#', '') as b, p_size as n, lower(p_name) as name from part),
  t as (select distinct lower(b || '-' || n) as token, lower(b) as owner, n from p),
  a as (select p_partkey, case p_partkey % 4 when 0 then 'Mozilla/5.0 (compatible; ' || b || '-' || n || '; v' || p_partkey || '; +http://x.example/' || b || '-1)'
    when 1 then b || 'Fetch/' || p_partkey || ' (compatible)' when 2 then 'Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/' || p_partkey || '.0 Safari/537.36'
    else 'acme-' || name || '-crawler/' || p_partkey end as ua, b from p),
  m as (select p_partkey, token, owner, n from a join t on contains(lower(ua), token) qualify row_number() over (partition by p_partkey order by strpos(lower(ua), token), length(token) desc) = 1)
select a.p_partkey, ua, case when token is not null then case when n % 2 = 1 then 'ai_training' else 'seo_tool' end when regexp_matches(ua, '^Brand[0-9]+Fetch/[0-9]+') then 'ai_fetcher'
    when contains(ua, 'crawl') then 'other_bot' else 'human' end as actor_type,
  case when token is not null then token when regexp_matches(ua, '^Brand[0-9]+Fetch/[0-9]+') then lower(b) || 'fetch' else '' end as bot_id, coalesce(owner, '') as operator
from a left join m using (p_partkey)"""
_HELD = "asof left join {t} {n} on a.k = {n}.k and a.ts >= {n}.ts"
SQL["fcrdns"] = f"""with e as (select event_id, ts::timestamp as ts, user_id % 50 as k from events),
  a as (select distinct k, ts from e where event_id % 7 > 2), p as (select k, ts, event_id % 5 as c from e where event_id % 7 = 0),
  h4 as (select k, ts, event_id % 4 as c from e where event_id % 7 = 1), h6 as (select k, ts, event_id % 4 as c from e where event_id % 7 = 2),
  j as (select a.k, a.ts, case when a.ts < p.ts + interval 1 hour then p.c end as p, case when a.ts < x.ts + interval 2 hours then x.c end as x, case when a.ts < y.ts + interval 2 hours then y.c end as y
    from a {_HELD.format(t='p', n='p')} {_HELD.format(t='h4', n='x')} {_HELD.format(t='h6', n='y')})
select '10.0.0.' || k as ip, ts, case when p is null or p = 1 then 'transient' when p in (0, 4) then 'spoofed' when x = 2 or y = 2 then 'verified' when x > 0 and y > 0 then 'spoofed' else 'transient' end as outcome from j"""
SQL["distinct_sketches"] = _q("""select site_id, cast(d as varchar) as date, count(distinct ip_hash) as visitors, count(distinct session_id) as sessions, count(distinct path_group) as pages,
    count(distinct nullif(bot_id, '')) as bots, true as visitors_ok, true as sessions_ok, true as pages_ok, true as bots_ok
  from (select *, ts::date as d from events_enriched) group by grouping sets ((site_id, d), (site_id))""")
SQL["alerts_all_sites"] = _q(f"""select rule, site_id, subject, value, base from (
  select 'spike' as rule, site_id, 'ai' as subject, count(*) filter (ts > {_EARLY} - interval 1 hour) as value, round(count(*) filter (ts <= {_EARLY} - interval 1 hour) / 167, 9) as base
    from w where {_AI} and {_REAL} and ts > {_EARLY} - interval 7 days group by site_id having value >= 20 and base > 0 and value > 0.5 * base
  union all select 'new_bot', site_id, bot_id, count(*), null from w where ts >= {_EARLY} - interval 180 minutes and {_REAL} and bot_id <> ''
    and (site_id, bot_id) not in (select (site_id, bot_id) from w where ts < {_EARLY} - interval 180 minutes) and site_id in (select site_id from w where ts < {_EARLY} - interval 180 minutes) group by all
  union all select 'spoof', site_id, bot_id, count(*), null from w where verification = 'spoofed' and ts > {_EARLY} - interval 180 minutes group by all
  union all select 'broken_citation', site_id, path_group, count(*), null from w where actor_type in ('ai_fetcher', 'ai_search') and {_REAL} and status >= 400 and status not in (401, 403)
    and ts > {_EARLY} - interval 180 minutes and (site_id, path_group) in (select (site_id, path_group) from events_enriched where actor_type in ('ai_fetcher', 'ai_search') and {_REAL}
      and cast(ts as date) > date '2024-01-01' - 31 group by site_id, path_group having count(*) > count(*) filter (status >= 400)) group by all)
  qualify row_number() over (partition by rule, site_id order by value desc, subject) <= 20""", f"w as (select * from events_enriched where ts <= {_EARLY} and ts >= {_EARLY} - interval 30 days)")
SQL["merged_ranges_one_owner"] = """with r as (select o_orderkey * 37 % 1000003 as lo, o_orderkey * 37 % 1000003 + o_orderkey % 9 as hi from orders),
  m as (select *, max(hi) over (order by lo, hi rows between unbounded preceding and 1 preceding) as reach from r), g as (select *, sum(case when lo <= reach + 1 then 0 else 1 end) over (order by lo, hi rows unbounded preceding) as k from m)
select 'all' as owner, lpad(lower(to_hex(min(lo)::bigint)), 8, '0') as first, lpad(lower(to_hex(max(hi)::bigint)), 8, '0') as last from g group by k"""
SQL["sessions_one_key"] = """with a as (select event_id, ts::timestamp as ts, case when ts - lag(ts) over (order by ts) <= interval 30 minutes then 0 else 1 end as f from events),
  b as (select *, sum(f) over (order by ts rows unbounded preceding) as k from a) select event_id, min(ts) over (partition by k) as session_start from b"""
SQL["bots_truncated"] = _q("select most::int as most, least(most, n)::bigint as shown, n > most as more from (select count(distinct bot_id) as n from w where bot_id <> ''), (values (3), (100)) t(most)", _W1)
_V4 = "{0}0a00' || lpad(lower(to_hex({1})), 2, '0') || lpad(lower(to_hex({2})), 2, '0')"
_V6 = "{0}20010db8' || lpad(lower(to_hex({1})), 4, '0') || repeat('0', 16) || lpad(lower(to_hex({2})), 4, '0')"
_ASKED = {
    "ip_network_nested": ("'10.0.' || event_id % 5 || '.' || user_id % 40", _V4.format("'", "event_id % 5", "user_id % 40"), [("0a000000", "0a00ffff", 1), ("0a000100", "0a000107", 2), ("0a000200", "0a0002ff", 0), ("0a000310", "0a00031f", 3)]),
    "ip_network_v6": (
        "'2001:DB8:' || lower(to_hex(event_id % 7)) || '::' || lower(to_hex(user_id % 40))", _V6.format("'", "event_id % 7", "user_id % 40"),
        [("20010db8" + "0" * 24, "20010db80003" + "f" * 20, 4), ("20010db80001" + "0" * 20, "20010db80001" + "0" * 19 + "f", 5), ("20010db80005" + "0" * 18 + "10", "20010db80005" + "0" * 18 + "1f", 6)],
    ),
}
for _name, (_ip, _key, _nets) in _ASKED.items():
    _values = ", ".join(f"('{a}', '{b}', {k}::bigint)" for a, b, k in _nets)
    SQL[_name] = (
        f"with a as (select distinct {_ip} as ip, {_key} as key from events), r(first, last, asn) as (values {_values}) "
        "select ip, key, case when key <= last then asn else 0 end as asn from (select a.*, coalesce(r.last, '') as last, coalesce(r.asn, 0) as asn from a asof left join r on a.key >= r.first)"
    )
SQL["cidr_ends"] = (
    "with c as (select distinct o_orderkey % 256 as x, o_custkey % 256 as y, o_orderkey % 33 as b from orders), "
    "n as (select *, 10::bigint * 16777216 + x * 65536 + y * 256 + 77 as ip, (1::bigint << (32 - b)::int) as size from c) "
    "select '10.' || x || '.' || y || '.77/' || b as cidr, lpad(lower(to_hex(ip - ip % size)), 8, '0') as first, lpad(lower(to_hex(ip - ip % size + size - 1)), 8, '0') as last from n"
)
SQL["registry_merge"] = (
    "with s as (select p_partkey % 3 as k, trim(regexp_replace(lower('Bot ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as bot_id, min(p_type) as op, min(p_name) as p from part group by all), "
    "u as (select bot_id, p, max(k) as k from s group by all) "
    "select bot_id, coalesce(max(op) filter (s.k = 1), max(op) filter (s.k = 0)) as operator, case max(s.k) when 2 then 'ai_search' when 1 then 'ai_training' else 'other_bot' end as actor_type, "
    "(select string_agg(p, '|' order by u.k desc) from u where u.bot_id = s.bot_id) as patterns, string_agg('.s' || s.k || '.net', '|' order by s.k desc) as suffixes from s group by bot_id"
)
for _site, _name, _people in (("site_1", "blind_spots", "session_id in (select session_id from w where actor_type = 'human' and regexp_matches(path_group, '\\.(css|js)$'))"), ("site_2", "blind_spots_failopen", "true")):
    _read = "actor_type = 'human' and status < 400 and method in ('GET', 'HEAD')"
    SQL[_name] = _q(
        f"select path_group as page, count(*) filter ({_read}) as human_hits, count(distinct session_id) filter ({_read}) as readers from w where {_CONTENT} and (actor_type <> 'human' or {_people}) group by 1 having count(*) filter ({_AI} and {_REAL}) = 0 and human_hits > 0 order by human_hits desc, page limit 50",
        f"w as (select * from events_enriched where site_id = '{_site}' and ts >= {_AS_OF} - interval {DAYS} days)",
    )
SQL["page_urls"] = (
    "with p as (select page_id, url, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '#.*$', '') as path from pages) "
    f"select page_id, regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)), '^(http://[^:]*):80$|^(https://[^:]*):443$', '\\1\\2') as origin, {_GROUP} as path_group from p"
)


def flagship(spark: SparkSession) -> DataFrame:
    """Top pages by AI attention over the last week of the smallest log."""
    return derived.panels(spark, "/root/testdata/sf0.001").top_pages(HOURS)
