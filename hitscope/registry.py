"""The bot registry: a small list of well-known agents, and the compiler that merges source lists.

An entry: bot_id, operator, actor_type, ua_patterns, and whether the vendor publishes address ranges (`ip_source`)
or reverse-DNS suffixes (`rdns_suffixes`).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTOR_TYPES = ["human", "ai_training", "ai_search", "ai_fetcher", "search_engine", "seo_tool", "social", "monitoring", "other_bot", "suspected_ai"]

SCHEMA = "bot_id string, operator string, actor_type string, ua_patterns array<string>, ip_source string, rdns_suffixes array<string>, docs_url string"

#: bot_id, operator, actor_type, patterns, published ranges (a URL or ''), reverse-DNS suffixes. Fixed values, from the vendors' public pages.
_BOTS: list[tuple[str, str, str, list[str], str, list[str]]] = [
    ("gptbot", "openai", "ai_training", ["GPTBot"], "https://openai.com/gptbot.json", []),
    ("oai-searchbot", "openai", "ai_search", ["OAI-SearchBot"], "https://openai.com/searchbot.json", []),
    ("chatgpt-user", "openai", "ai_fetcher", ["ChatGPT-User"], "https://openai.com/chatgpt-user.json", []),
    ("claudebot", "anthropic", "ai_training", ["ClaudeBot"], "https://claude.com/crawling/bots.json", []),
    ("claude-searchbot", "anthropic", "ai_search", ["Claude-SearchBot"], "https://claude.com/crawling/bots.json", []),
    ("claude-user", "anthropic", "ai_fetcher", ["Claude-User"], "https://claude.com/crawling/bots.json", []),
    ("perplexitybot", "perplexity", "ai_search", ["PerplexityBot"], "https://perplexity.com/perplexitybot.json", []),
    ("perplexity-user", "perplexity", "ai_fetcher", ["Perplexity-User"], "https://perplexity.com/perplexity-user.json", []),
    ("bytespider", "bytedance", "ai_training", ["Bytespider"], "", []),
    ("ccbot", "common-crawl", "ai_training", ["CCBot"], "https://index.commoncrawl.org/ccbot.json", [".crawl.commoncrawl.org"]),
    ("meta-externalagent", "meta", "ai_training", ["meta-externalagent"], "", []),
    ("meta-externalfetcher", "meta", "ai_fetcher", ["meta-externalfetcher"], "", []),
    ("applebot-extended", "apple", "ai_training", ["Applebot-Extended"], "", []),
    ("applebot", "apple", "search_engine", ["Applebot"], "https://search.developer.apple.com/applebot.json", [".applebot.apple.com"]),
    ("amazonbot", "amazon", "ai_training", ["Amazonbot"], "", [".crawl.amazonbot.amazon"]),
    ("google-extended", "google", "ai_training", ["Google-Extended"], "", []),
    ("mistralai-user", "mistral", "ai_fetcher", ["MistralAI-User"], "", []),
    ("deepseekbot", "deepseek", "ai_training", ["DeepSeekBot"], "", []),
    ("cohere-ai", "cohere", "ai_training", ["cohere-ai"], "", []),
    ("diffbot", "diffbot", "ai_training", ["Diffbot"], "", []),
    ("duckassistbot", "duckduckgo", "ai_fetcher", ["DuckAssistBot"], "", []),
    ("youbot", "you", "ai_search", ["YouBot"], "", []),
    ("googlebot", "google", "search_engine", ["Googlebot\\/", "Googlebot"], "https://developers.google.com/search/apis/ipranges/googlebot.json", [".googlebot.com", ".google.com"]),
    ("bingbot", "microsoft", "search_engine", ["bingbot"], "https://www.bing.com/toolbox/bingbot.json", [".search.msn.com"]),
    ("duckduckbot", "duckduckgo", "search_engine", ["DuckDuckBot"], "", []),
    ("yandexbot", "yandex", "search_engine", ["YandexBot"], "", [".yandex.ru", ".yandex.net", ".yandex.com"]),
    ("baiduspider", "baidu", "search_engine", ["Baiduspider"], "", [".baidu.com", ".baidu.jp"]),
    ("petalbot", "huawei", "search_engine", ["PetalBot"], "", []),
    ("ahrefsbot", "ahrefs", "seo_tool", ["AhrefsBot"], "https://api.ahrefs.com/v3/public/crawler-ips", []),
    ("semrushbot", "semrush", "seo_tool", ["SemrushBot"], "", []),
    ("mj12bot", "majestic", "seo_tool", ["MJ12bot"], "", []),
    ("dotbot", "moz", "seo_tool", ["DotBot"], "", []),
    ("screaming-frog", "screaming-frog", "seo_tool", ["Screaming Frog SEO Spider"], "", []),
    ("facebookexternalhit", "meta", "social", ["facebookexternalhit"], "", []),
    ("twitterbot", "x", "social", ["Twitterbot"], "", []),
    ("linkedinbot", "linkedin", "social", ["LinkedInBot"], "", []),
    ("slackbot", "slack", "social", ["Slackbot", "Slack-ImgProxy"], "", []),
    ("discordbot", "discord", "social", ["Discordbot"], "", []),
    ("telegrambot", "telegram", "social", ["TelegramBot"], "", []),
    ("whatsapp", "meta", "social", ["^WhatsApp\\/[0-9.]+"], "", []),
    ("uptimerobot", "uptimerobot", "monitoring", ["UptimeRobot"], "", []),
    ("pingdom", "pingdom", "monitoring", ["Pingdom\\.com_bot"], "", []),
    ("datadog-synthetics", "datadog", "monitoring", ["DatadogSynthetics"], "", []),
    ("spider", "unknown", "ai_training", ["Spider"], "", []),
    ("ia-archiver", "internet-archive", "other_bot", ["ia_archiver", "archive.org_bot"], "", []),
]


def entries() -> list[dict[str, Any]]:
    """The shipped registry, by bot_id."""
    out = [
        {"bot_id": b, "operator": o, "actor_type": a, "ua_patterns": p, "ip_source": s or None, "rdns_suffixes": r, "docs_url": None}
        for b, o, a, p, s, r in _BOTS
    ]
    return sorted(out, key=lambda e: e["bot_id"])


def frame(spark: SparkSession, bots: list[dict[str, Any]] | None = None) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in (entries() if bots is None else bots)], SCHEMA)


#: Words that say "automation" and nothing about whose. Fixed values.
GENERIC_IDENTITIES = ["bot", "spider", "crawl", "crawler", "search", "fetch", "scan", "archive", "code", "feed", "java", "ruby", "perl"]


def has_generic_identity(entry: dict[str, Any]) -> bool:
    return any(p.strip().lower() in GENERIC_IDENTITIES for p in entry["ua_patterns"])


def generic_identity(patterns: Column) -> Column:
    return F.arrays_overlap(F.transform(patterns, lambda p: F.lower(F.trim(p))), F.array(*map(F.lit, GENERIC_IDENTITIES)))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normal_id(x: Column) -> Column:
    return slug(F.replace(x, F.lit("\\/"), F.lit("/")))


def normal_operator(x: Column) -> Column:
    """Markdown links are taken off, & is "and"; empty or "unclear" is "unknown"."""
    bare = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\[([^\]]+)\]\([^)]+\)", "$1"))
    unknown = (bare == "") | F.contains(F.lower(bare), F.lit("unclear"))
    return F.when(unknown, F.lit("unknown")).otherwise(slug(F.replace(bare, F.lit("&"), F.lit("and"))))


def from_robots_list(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, operator, function) rows of a declared-AI-crawler list to registry rows."""
    f = F.lower(F.coalesce("function", F.lit("")))
    kind = (
        F.when(F.contains(f, F.lit("search")), "ai_search")
        .when(f.rlike("assistant|agent|fetch"), "ai_fetcher")
        .otherwise("ai_training")
    )
    got = df.select(
        normal_id(F.col("name")).alias("bot_id"), normal_operator(F.col("operator")).alias("operator"), kind.alias("actor_type"),
        F.array("name").alias("ua_patterns"), F.lit(None).cast("string").alias("ip_source"), F.array().cast("array<string>").alias("rdns_suffixes"),
        F.nullif(F.regexp_extract(F.coalesce("operator", F.lit("")), r"\[[^\]]+\]\(([^)]+)\)", 1), F.lit("")).alias("docs_url"),
    )
    return _with_known(got, known)


def from_crawler_list(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(pattern, url, tags) rows of a crawler pattern list to registry rows."""
    p = F.regexp_replace("pattern", r"\\([/.^$*+?()\[\]{}|])", "")
    for cut in (r"\(\?:.*$", r"\(\[\^.*$", r"\(\.\*\)$", "/$"):
        p = F.regexp_replace(p, cut, "")
    host = F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), "^www\\.", "")
    labels = F.split(host, "\\.")
    owner = F.coalesce(F.get(labels, F.size(labels) - 2), F.lit(""))
    tag = lambda *names: F.arrays_overlap(F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower), F.array(*map(F.lit, names)))
    kind = (
        F.when(tag("search-engine"), "search_engine").when(tag("monitoring"), "monitoring").when(tag("social"), "social")
        .when(tag("seo", "seo-tool"), "seo_tool").otherwise("other_bot")
    )
    got = df.select(
        normal_id(p).alias("bot_id"), normal_operator(owner).alias("operator"), kind.alias("actor_type"), F.array("pattern").alias("ua_patterns"),
        F.lit(None).cast("string").alias("ip_source"), F.array().cast("array<string>").alias("rdns_suffixes"), F.nullif(F.coalesce("url", F.lit("")), F.lit("")).alias("docs_url"),
    )
    return _with_known(got, known)


def _with_known(got: DataFrame, known: DataFrame | None) -> DataFrame:
    """A taxonomy (bot_id, operator, actor_type) overrides what was read from a list."""
    if known is None:
        return got
    k = known.select("bot_id", F.col("operator").alias("_o"), F.col("actor_type").alias("_a"))
    return got.join(F.broadcast(k), "bot_id", "left").select(
        "bot_id", F.coalesce("_o", "operator").alias("operator"), F.coalesce("_a", "actor_type").alias("actor_type"), "ua_patterns", "ip_source", "rdns_suffixes", "docs_url"
    )


def compile_registry(crawlers: DataFrame | None = None, robots: DataFrame | None = None, custom: DataFrame | None = None) -> DataFrame:
    """Merges registry rows by bot_id: custom over robots over crawlers. The winner's fields count, the others fill gaps;
    patterns are the winner's first, then the rest; suffixes are joined."""
    ranked = [df.withColumn("_rank", F.lit(r)) for df, r in ((crawlers, 1), (robots, 2), (custom, 3)) if df is not None]
    rows = ranked[0]
    for df in ranked[1:]:
        rows = rows.unionByName(df)
    top = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("_rank"), F.col(c)))).alias(c)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("_rank")).alias("r"), "ua_patterns")))
    suffixes = F.sort_array(F.collect_list(F.struct((-F.col("_rank")).alias("r"), F.coalesce("rdns_suffixes", F.array().cast("array<string>")).alias("s"))))
    return rows.groupBy("bot_id").agg(
        top("operator"), top("actor_type"), F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["ua_patterns"]))).alias("ua_patterns"),
        top("ip_source"), F.array_distinct(F.flatten(F.transform(suffixes, lambda x: x["s"]))).alias("rdns_suffixes"), top("docs_url"),
    )
