"""A request log derived from the `events` table, by arithmetic that Spark and other SQL engines share."""

from __future__ import annotations

import datetime as dt

import uuid

from pyspark.sql import DataFrame, SparkSession

from hitscope import registry
from hitscope.operators import ranges, rollups
from hitscope.operators.enrich import Dimensions, enrich
from hitscope.plans.panels import Panels
from hitscope.sources.sinks import read_events, write_events
from hitscope.storage import shared_dir

AS_OF = dt.datetime(2024, 1, 31)
SECRET = "secret"

AGENTS = {
    0: "Mozilla/5.0 (compatible; GPTBot/1.2; +https://openai.com/gptbot)",
    1: "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    2: "Mozilla/5.0 (compatible; OAI-SearchBot/1.0)",
    3: "Mozilla/5.0 (compatible; ChatGPT-User/1.0)",
    4: "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    5: "Mozilla/5.0 (compatible; Googlebot/2.1)",
    6: "Mozilla/5.0 (compatible; ClaudeBot/1.0)",
    7: "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Safari/604.1",
    8: "Mozilla/5.0 (compatible; PerplexityBot/1.0)",
    9: "Mozilla/5.0 (Linux; Android 5.0) Bytespider",
    10: "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Edg/120.0",
    11: "curl/8.4.0",
    12: "Mozilla/5.0 (compatible; AhrefsBot/7.0)",
    13: "Mozilla/5.0 (Linux; Android 14; Pixel 8) Mobile Safari/537.36",
    14: "Mozilla/5.0 (compatible; Claude-User/1.0)",
    15: "CCBot/2.0",
    16: "facebookexternalhit/1.1",
    17: "Mozilla/5.0 (Macintosh) Version/17.0 Safari/605.1.15",
    18: "Mozilla/5.0 (compatible; bingbot/2.0)",
    19: "Mozilla/5.0 (compatible; UptimeRobot/2.0)",
}
PATHS = [
    "'/blog/alpha'", "'/blog/beta'", "'/blog/gamma/'", "'/users/' || cast(user_id as string) || '/profile'", "'/orders/3f2504e0-4f89-11d3-9a0c-0305e82c3301'",
    "'/files/deadbeefcafe'", "'/robots.txt'", "'/sitemap.xml'", "'/.well-known/security.txt'", "'/.env'", "'/docs/api'", "'/pricing?utm_source=chatgpt.com'", "'/'",
    "'/blog/alpha?utm_source=perplexity&x=1'", "'/guide/setup'", "'/about'",
]
REFERERS = [
    "https://chatgpt.com/", "https://www.perplexity.ai/search?q=1", "https://claude.ai/chat/9", "https://gemini.google.com/app", "https://www.bing.com/chat?q=2",
    "https://www.google.com/", "", "chatgpt.com",
]


def raw_sql(later: str = "timestampadd(SECOND, 2 * i, ts)") -> str:
    """The log as SQL over `events`; later: two seconds after ts for each step i, in the engine's own words."""
    ua = " ".join(f"when {k} then '{v}'" for k, v in AGENTS.items())
    path = " ".join(f"when {k} then {v}" for k, v in enumerate(PATHS))
    referer = " ".join(f"when {k} then '{v}'" for k, v in enumerate(REFERERS))
    browser = "persona in (1, 4, 7, 10, 13, 17)"
    return f"""
select 'site_' || cast(user_id % 3 as string) as site_id, {later} as ts,
  case when {browser} then '192.0.2.' || cast(user_id % 200 as string) when event_id % 7 = 0 then '203.0.113.' || cast(event_id % 80 as string)
       else '198.51.100.' || cast(user_id % 200 as string) end as ip,
  case when i > 0 then 'get' when event_id % 11 = 0 then 'HEAD' when event_type = 'purchase' then 'POST' else 'GET' end as method,
  case i when 1 then '/assets/app.css' when 2 then '/assets/app.js' else case (event_id * 13 + user_id * 7) % 16 {path} end end as path,
  case when i > 0 then 200 when event_type = 'error' then case event_id % 4 when 0 then 404 when 1 then 500 when 2 then 403 else 401 end
       when event_id % 9 = 8 then 301 when event_id % 9 = 7 then 204 else 200 end as status,
  cast(floor(value * 100) as bigint) as bytes, case persona {ua} end as ua,
  case when {browser} then case event_id % 8 {referer} end else '' end as referer,
  cast(event_id % 500 as double) as response_ms, cast(null as string) as country, cast(null as bigint) as asn, cast(null as string) as as_org
from (select *, user_id % 20 as persona from events cross join (values (0), (1), (2)) as v(i))
where i = 0 or ({browser} and user_id % 3 <> 2 and user_id % 7 not in (0, 3))
"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    return spark.sql(raw_sql().replace("from events", "from {events}"), events=events)


NETWORKS = [
    ("198.51.100.0", "198.51.100.127", 64500, "US", "Example Hosting"), ("203.0.113.0", "203.0.113.63", 64501, "NL", "Forge Net"),
    ("192.0.2.0", "192.0.2.99", 64502, "DE", "Home ISP"), ("192.0.2.100", "192.0.2.149", 0, "FR", ""),
]
BLOCKS = ["198.51.100.0/25", "198.51.100.128/26", "198.51.100.192/26"]


def dimensions(spark: SparkSession) -> Dimensions:
    from pyspark.sql import functions as F

    from hitscope.functions.ip import ip_key

    bots = registry.entries()
    cidrs = spark.createDataFrame([(e["bot_id"], c) for e in bots if e["ip_source"] for c in BLOCKS], "bot_id string, cidr string")
    nets = spark.createDataFrame(NETWORKS, "a string, b string, asn bigint, country string, as_org string")
    return Dimensions(
        bots, ranges.merged(ranges.from_cidrs(cidrs), ["bot_id"]),
        nets.select(ip_key(F.col("a")).alias("first"), ip_key(F.col("b")).alias("last"), "asn", "country", "as_org"),
    )


#: Events that a task sorts for their sessions, with the files that their pages load: 280 MB at most over 6 million events.
EVENTS_A_TASK = 200_000


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the count comes from the files' footers
    parts = spark.read.parquet(f"{sf_dir}/events.parquet").count() // EVENTS_A_TASK
    return enrich(raw(spark, sf_dir), dimensions(spark), SECRET, parts=parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None)


_stored: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """Where the enriched log, by month, and its rollups are; written once a session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{shared_dir(spark)}/hitscope/log-{uuid.uuid4().hex}"
        write_events(enriched(spark, sf_dir), f"{path}/events")
        events = read_events(spark, f"{path}/events")
        for name in rollups.KEYS:
            rollups.build(events, name).write.parquet(f"{path}/{name}")
        _stored[key] = path
    return _stored[key]


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched log as the table that panels read."""
    return read_events(spark, f"{_folder(spark, sf_dir)}/events")


def panels(spark: SparkSession, sf_dir: str, site: str | None = None, as_of: dt.datetime = AS_OF) -> Panels:
    folder = _folder(spark, sf_dir)
    return Panels(stored(spark, sf_dir), as_of, {name: spark.read.parquet(f"{folder}/{name}") for name in rollups.KEYS}, site)
