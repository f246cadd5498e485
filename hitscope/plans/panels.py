"""The panels: each a DataFrame over one site's enriched events, as of a given moment."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Files that are no content, and those a browser loads to render a page. Fixed values.
ASSETS = r"(?i)\.(css|js|mjs|map|json|xml|txt|png|jpe?g|gif|webp|avif|svg|ico|woff2?|ttf|otf|eot|mp3|mp4|webm|pdf|zip|gz)\z"
RENDERED = r"(?i)\.(css|js|mjs|png|jpe?g|gif|webp|avif|svg|woff2?)\z"
#: Crawling operator to the referral source of the same vendor's assistant. Fixed values.
ASSISTANTS = {
    "openai": "chatgpt", "anthropic": "claude", "perplexity": "perplexity", "google": "gemini", "microsoft": "copilot", "deepseek": "deepseek", "xai": "grok",
    "mistral": "mistral", "meta": "meta",
}


#: Characters of a search text.
LONGEST_SEARCH = 200


def is_ai() -> Column:
    return F.startswith("actor_type", F.lit("ai_"))


def genuine() -> Column:
    return F.col("verification") != "spoofed"


def content() -> Column:
    return ~F.col("path_group").rlike(ASSETS) & ~F.startswith("path_group", F.lit("/.well-known/"))


def clicked() -> Column:
    return (F.col("actor_type") == "human") & (F.col("ai_referral") != "")


def broken() -> Column:
    return (F.col("status") >= 400) & ~F.col("status").isin(401, 403)


def kind(name: str) -> Column:
    return F.col("actor_type") == name


def n(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def hits() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def checked(value: int, most: int, what: str) -> int:
    if not 1 <= value <= most:
        raise ValueError(f"{what} must be from 1 to {most}")
    return value


@dataclass
class Panels:
    """events: enriched; rollups: by name; site None: all sites. Nothing runs until a result is used, but for `has_assets`."""

    events: DataFrame
    as_of: dt.datetime
    rollups: dict[str, DataFrame] | None = None
    site: str | None = None
    approximate: bool = False

    def _site(self, df: DataFrame) -> DataFrame:
        return df if self.site is None else df.filter(F.col("site_id") == self.site)

    def _since(self, df: DataFrame, start: dt.datetime) -> DataFrame:
        return df.filter(F.col("month") >= start.strftime("%Y%m")) if "month" in df.columns else df

    def hours(self, h: int) -> DataFrame:
        """Events of the last h hours, without the one exactly h hours old."""
        start = self.as_of - dt.timedelta(hours=checked(h, 8760, "hours"))
        return self._since(self._site(self.events), start).filter(F.col("ts") > F.lit(start).cast("timestamp_ntz"))

    def before(self, h: int) -> DataFrame:
        """Events of the h hours before those."""
        end = self.as_of - dt.timedelta(hours=checked(h, 8760, "hours"))
        start = end - dt.timedelta(hours=h)
        return self._since(self._site(self.events), start).filter((F.col("ts") > F.lit(start).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))

    def days(self, d: int) -> DataFrame:
        """Events of the last d days, with the one exactly d days old."""
        start = self.as_of - dt.timedelta(days=checked(d, 365, "days"))
        return self._since(self._site(self.events), start).filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))

    def rollup(self, name: str, d: int) -> DataFrame:
        """Rows of a rollup of the last d dates, today's with them."""
        first = self.as_of.date() - dt.timedelta(days=checked(d, 365, "days"))
        return self._site((self.rollups or {})[name]).filter(F.col("date") > F.lit(first))

    def distinct(self, c: Column) -> Column:
        return (F.approx_count_distinct(c) if self.approximate else F.countDistinct(c)).cast("bigint")

    # overview

    def _kpis(self, df: DataFrame) -> DataFrame:
        ai = is_ai() & genuine()
        return df.agg(
            n(ai).alias("ai_hits"), n(ai & (F.col("verification") == "verified")).alias("ai_verified"),
            n(ai & F.col("verification").isin("unverified", "na")).alias("ai_unverified"),
            self.distinct(F.when((F.col("bot_id") != "") & genuine(), F.col("bot_id"))).alias("unique_bots"),
            n(F.col("verification") == "verified").alias("verified"), n(~genuine()).alias("spoofed"),
            n(F.col("ai_referral") != "").alias("ai_referrals"), n(~kind("human") & (F.col("status") >= 400) & genuine()).alias("bot_errors"),
        )

    def kpis(self, h: int = 24) -> DataFrame:
        return self._kpis(self.hours(h))

    def kpis_before(self, h: int = 24) -> DataFrame:
        return self._kpis(self.before(h))

    def top_pages(self, h: int = 24, limit: int = 100, search: str = "") -> DataFrame:
        rows = self.hours(h)
        checked(limit, 100, "limit")
        if len(search) > LONGEST_SEARCH:
            raise ValueError(f"search must have at most {LONGEST_SEARCH} characters")
        if search:
            rows = rows.filter(F.contains(F.lower("path_group"), F.lower(F.lit(search))))
        ai = is_ai() & genuine()
        real = lambda k: n(kind(k) & genuine())
        return (
            rows.groupBy("path_group").agg(
                n(ai).alias("ai_hits"), real("ai_training").alias("training_hits"), real("ai_search").alias("search_hits"), real("ai_fetcher").alias("fetcher_hits"),
                self.distinct(F.when(ai & (F.col("bot_id") != ""), F.col("bot_id"))).alias("ai_bots"), hits().alias("hits"), F.max(F.when(ai, F.col("ts"))).alias("last_ai_hit"),
            )
            .filter("ai_hits > 0").orderBy(F.desc("ai_hits"), F.desc("hits"), "path_group").limit(limit)
        )

    def top_bots(self, h: int = 24, limit: int = 10) -> DataFrame:
        latest = F.struct("ts", "operator", "actor_type")
        return (
            self.hours(h).filter("bot_id != ''").groupBy("bot_id").agg(
                F.max_by("operator", latest).alias("operator"), F.max_by("actor_type", latest).alias("actor_type"), hits().alias("hits"),
                self.distinct(F.col("path_group")).alias("pages"), n(~genuine()).alias("spoofed"), n(F.col("status") >= 400).alias("errors"), F.max("ts").alias("last_seen"),
            )
            .orderBy(F.desc("hits"), "bot_id").limit(limit)
        )

    def bots(self, h: int = 24, most: int = 100) -> tuple[DataFrame, bool]:
        """The top bots, and whether there are more than are shown."""
        rows = self.top_bots(h, most + 1)
        return rows.limit(most), rows.count() > most

    def bots_flagged(self, h: int = 24, most: int = 100) -> DataFrame:
        """The top bots, each with `more`: whether there are more than are shown."""
        rows = self.top_bots(h, most + 1)
        # one row more than is shown at most, so one window holds them
        return rows.withColumn("more", F.count(F.lit(1)).over(W.partitionBy()) > most).orderBy(F.desc("hits"), "bot_id").limit(most)

    def hourly(self, h: int = 24) -> DataFrame:
        return self.hours(h).filter(genuine()).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), "actor_type").agg(hits().alias("hits"))

    def hourly_wide(self, h: int = 24) -> DataFrame:
        """One row an hour, one column a kind of actor that occurs."""
        return self.hourly(h).groupBy("t").pivot("actor_type").agg(F.sum("hits")).orderBy("t")

    def referrals(self, h: int = 24) -> DataFrame:
        return self.hours(h).filter("ai_referral != ''").groupBy(F.col("ai_referral").alias("source")).agg(hits().alias("hits")).orderBy(F.desc("hits"), "source")

    def recent(self, h: int = 24, limit: int = 30) -> DataFrame:
        rows = self.hours(h).filter(~kind("human") | (F.col("ai_referral") != ""))
        cols = ["ts", "actor_type", "bot_id", "operator", "verification", "path", "status", "ai_referral"]
        return rows.select(*cols).orderBy(F.desc("ts"), "path", "bot_id", "status", "actor_type", "verification", "ai_referral").limit(limit)

    def sites(self) -> DataFrame:
        return self.events.select("site_id").distinct().orderBy("site_id")

    def overview(self, h: int = 24) -> dict[str, DataFrame]:
        return {
            "kpis": self.kpis(h), "before": self.kpis_before(h), "hourly": self.hourly_wide(h), "bots": self.top_bots(h, 10), "pages": self.top_pages(h, 10),
            "referrals": self.referrals(h), "recent": self.recent(h), "sites": self.sites(),
        }

    # one bot

    def bot_detail(self, bot_id: str, h: int = 24) -> dict[str, DataFrame]:
        rows = self.hours(h).filter(F.col("bot_id") == bot_id)
        return {
            "hourly": rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(hits().alias("hits")).orderBy("t"),
            "paths": rows.groupBy("path_group").agg(hits().alias("hits"), n(F.col("status") >= 400).alias("errors"), F.max("ts").alias("last_seen")).orderBy(F.desc("hits"), "path_group").limit(20),
            "status": rows.groupBy(F.concat((F.col("status") / 100).cast("int").cast("string"), F.lit("xx")).alias("status_class")).agg(hits().alias("hits")).orderBy("status_class"),
            "sources": rows.filter("bot_ip != ''").groupBy("bot_ip").agg(
                F.max_by("country", F.struct("ts", "country")).alias("country"), F.max_by("as_org", F.struct("ts", "as_org")).alias("as_org"),
                F.max_by("verification", F.struct("ts", "verification")).alias("verification"), hits().alias("hits"),
            ).orderBy(F.desc("hits"), "bot_ip").limit(20),
            "countries": rows.filter("country != ''").groupBy("country").agg(hits().alias("hits")).orderBy(F.desc("hits"), "country").limit(10),
        }

    # security

    def spoofed_by_bot(self, h: int = 24) -> DataFrame:
        return self.hours(h).filter(~genuine()).groupBy("bot_id").agg(hits().alias("hits"), self.distinct(F.col("bot_ip")).alias("ips")).orderBy(F.desc("hits"), "bot_id")

    def spoofed_sources(self, h: int = 24, limit: int = 50) -> DataFrame:
        identity = F.struct("bot_id", "country", "as_org")
        return (
            self.hours(h).filter(~genuine() & (F.col("bot_ip") != "")).groupBy(F.col("bot_ip").alias("ip")).agg(
                F.max_by(identity, F.struct("ts", "bot_id", "country", "as_org")).alias("last"), self.distinct(F.col("bot_id")).alias("identities"), hits().alias("hits"), F.max("ts").alias("last_seen"),
            )
            .select("ip", "last.*", "identities", "hits", "last_seen").orderBy(F.desc("hits"), "ip").limit(limit)
        )

    def security(self, h: int = 24) -> dict[str, DataFrame]:
        return {"by_bot": self.spoofed_by_bot(h), "sources": self.spoofed_sources(h)}

    # pages and assistants

    def landing_pages(self, d: int = 30, limit: int = 50) -> DataFrame:
        return (
            self.days(d).filter(genuine()).groupBy(F.col("path_group").alias("page")).agg(
                n(kind("ai_training")).alias("training"), n(kind("ai_search")).alias("search"), n(kind("ai_fetcher")).alias("fetch"), n(clicked()).alias("clicked"),
            )
            .filter("clicked > 0").orderBy(F.desc("clicked"), F.desc(F.expr("training + search + fetch")), "page").limit(limit)
        )

    def pages_daily(self, d: int = 30, limit: int = 30) -> DataFrame:
        """Hits a day of the pages with the most, from the rollup."""
        rows = self.rollup("daily_page_ai_stats", d).filter(genuine()).select(F.col("path_group").alias("page"), "date", "hits")
        top = rows.groupBy("page").agg(F.sum("hits").alias("total")).orderBy(F.desc("total"), "page").limit(limit)
        return rows.join(top, "page", "left_semi").groupBy("page", "date").agg(F.sum("hits").alias("hits")).orderBy("page", "date")

    def pages_daily_dense(self, d: int = 30, limit: int = 30) -> DataFrame:
        """The same, with a row for each of the last d dates and 0 where there are none; pages by their total."""
        rows = self.pages_daily(d, limit)
        total = rows.groupBy("page").agg(F.sum("hits").alias("total"))
        first = self.as_of.date() - dt.timedelta(days=d - 1)
        axis = total.withColumn("date", F.explode(F.sequence(F.lit(first), F.lit(self.as_of.date()))))
        return axis.join(rows, ["page", "date"], "left").select("page", "date", "total", F.coalesce("hits", F.lit(0)).alias("hits")).orderBy(F.desc("total"), "page", "date")

    def retrieved_pages(self, d: int = 30, limit: int = 50) -> DataFrame:
        """Pages that assistants fetched, surfaced or sent people to."""
        rows = self.days(d).filter(genuine() & content() & (F.col("actor_type").isin("ai_fetcher", "ai_search") | clicked()))
        return (
            rows.groupBy(F.col("path_group").alias("page")).agg(
                n(kind("ai_fetcher")).alias("fetched"), n(kind("ai_search")).alias("surfaced"), n(clicked()).alias("clicked"), F.max("ts").alias("last_cited"),
            )
            .orderBy(F.desc(F.expr("fetched + clicked")), F.desc("surfaced"), "page").limit(limit)
        )

    def infra_hits(self, d: int = 30, limit: int = 5) -> DataFrame:
        rows = self.days(d).filter(genuine() & ~content() & F.col("actor_type").isin("ai_fetcher", "ai_search"))
        return rows.groupBy(F.col("path_group").alias("page")).agg(hits().alias("hits")).orderBy(F.desc("hits"), "page").limit(limit)

    def clicks_by_source(self, d: int = 30, rollup: bool = False) -> DataFrame:
        if rollup:
            got = self.rollup("daily_referrals", d).groupBy(F.col("ai_referral").alias("source")).agg(F.sum("hits").alias("clicks"))
        else:
            got = self.days(d).filter(clicked()).groupBy(F.col("ai_referral").alias("source")).agg(hits().alias("clicks"))
        return got.orderBy(F.desc("clicks"), "source")

    def crawls_by_operator(self, d: int = 30, rollup: bool = False) -> DataFrame:
        where = is_ai() & genuine() & (F.col("operator") != "")
        if rollup:
            got = self.rollup("daily_bot_stats", d).filter(where).groupBy("operator").agg(F.sum("hits").alias("crawls"))
        else:
            got = self.days(d).filter(where).groupBy("operator").agg(hits().alias("crawls"))
        return got.orderBy(F.desc("crawls"), "operator")

    def retrieval_feed(self, d: int = 30, limit: int = 30) -> DataFrame:
        rows = self.days(d).filter(genuine() & F.col("actor_type").isin("ai_fetcher", "ai_search"))
        return rows.select("ts", "bot_id", "operator", "actor_type", "path", "status").orderBy(F.desc("ts"), "path", "bot_id", "status").limit(limit)

    def citations(self, d: int = 30) -> dict[str, DataFrame]:
        return {
            "pages": self.retrieved_pages(d), "clicks": self.clicks_by_source(d), "crawls": self.crawls_by_operator(d), "feed": self.retrieval_feed(d), "infra": self.infra_hits(d),
        }

    # health

    def broken_pages(self, d: int = 30, limit: int = 50) -> DataFrame:
        rows = self.days(d).filter(is_ai() & genuine() & ~F.col("status").isin(401, 403))
        bad = F.col("status") >= 400
        return (
            rows.groupBy(F.col("path_group").alias("page")).agg(
                n(bad).alias("ai_errors"), F.max_by("status", F.when(bad, F.struct("ts", "status"))).alias("last_status"), F.max(F.when(bad, F.col("ts"))).alias("last_hit"),
                F.bool_or(F.col("status") < 400).alias("ever_ok"),
            )
            .filter("ai_errors > 0").orderBy(F.desc("ai_errors"), "page").limit(limit)
        )

    def has_assets(self, d: int = 30) -> bool:
        """Whether any person's browser loaded a file that renders a page; one small job."""
        return not self.days(d).filter(kind("human") & F.col("path_group").rlike(RENDERED)).limit(1).isEmpty()

    def blind_spots(self, d: int = 30, limit: int = 50) -> DataFrame:
        """Pages that people read and no genuine AI agent saw. People count if their session rendered a page,
        unless no session did (the site may serve its files from elsewhere)."""
        rows = self.days(d)
        people, agents = rows.filter(kind("human")), rows.filter(~kind("human"))
        if self.has_assets(d):
            browsing = people.filter(F.col("path_group").rlike(RENDERED)).select("session_id").distinct()
            people = people.join(browsing, "session_id", "left_semi")
        cols = ["path_group", "actor_type", "verification", "status", "method", "session_id"]
        reads = kind("human") & (F.col("status") < 400) & F.col("method").isin("GET", "HEAD")
        return (
            people.select(*cols).unionByName(agents.select(*cols)).filter(content()).groupBy(F.col("path_group").alias("page")).agg(
                n(is_ai() & genuine()).alias("ai"), n(reads).alias("human_hits"), self.distinct(F.when(reads, F.col("session_id"))).alias("readers"),
            )
            .filter("ai = 0 and human_hits > 0").drop("ai").orderBy(F.desc("human_hits"), "page").limit(limit)
        )

    def crawl_health(self, d: int = 30) -> dict[str, DataFrame]:
        return {"broken": self.broken_pages(d), "blind": self.blind_spots(d)}

    # vendors

    def take_vs_give(self, d: int = 30) -> DataFrame:
        """Each vendor's crawls against the visits its assistant sends; sources without a crawler are kept."""
        return combine(self.crawls_by_operator(d, rollup=True), self.clicks_by_source(d, rollup=True))


def combine(crawls: DataFrame, clicks: DataFrame) -> DataFrame:
    """(operator, crawls) and (source, clicks) to vendor, crawls, clicks, ratio, has_assistant."""
    table = F.create_map(*[F.lit(x) for kv in ASSISTANTS.items() for x in kv])
    by_operator = crawls.withColumn("source", F.try_element_at(table, F.col("operator")))
    left = by_operator.join(clicks, "source", "left").select(
        F.col("operator").alias("vendor"), "crawls", F.coalesce("clicks", F.lit(0)).cast("bigint").alias("clicks"), F.col("source").isNotNull().alias("has_assistant")
    )
    alone = clicks.join(by_operator.filter("source is not null").select("source").distinct(), "source", "left_anti").select(
        F.col("source").alias("vendor"), F.lit(0).cast("bigint").alias("crawls"), F.col("clicks").cast("bigint").alias("clicks"), F.lit(True).alias("has_assistant")
    )
    both = left.unionByName(alone)
    ratio = F.when(F.col("crawls") > 0, F.round(F.col("clicks") / F.col("crawls"), 9))
    return both.withColumn("ratio", ratio).orderBy(F.desc("crawls"), F.desc("clicks"), "vendor")


def verdicts(vendors: DataFrame) -> DataFrame:
    """A verdict on each row of take_vs_give, and the number of crawls from which silence tells something.

    The best click rate of any vendor sets that number: so many crawls at that rate would give a click with
    probability one half. Without any click at all, no number of crawls is enough.
    """
    rate = F.col("clicks") / F.col("crawls")
    best = vendors.agg(F.max(F.when((F.col("crawls") > 0) & (F.col("clicks") > 0), rate)).alias("best"))
    floor = F.when((F.col("best") > 0) & (F.col("best") < 1), F.ceil(F.log(F.lit(0.5)) / F.log1p(-F.col("best"))))
    told = vendors.join(F.broadcast(best.select(floor.cast("bigint").alias("floor"))), F.lit(True), "left")  # one row, always
    verdict = (
        F.when(~F.col("has_assistant"), "only-takes").when((F.col("clicks") > 0) & (F.col("crawls") == 0), "sends-without-crawling").when(F.col("clicks") > 0, "sends")
        .when(F.col("floor").isNull() | (F.col("crawls") < F.col("floor")), "not-enough").otherwise("sent-nobody")
    )
    return told.select(
        "vendor", "crawls", "clicks", "floor", verdict.alias("verdict"),
        F.when((F.col("clicks") > 0) & (F.col("crawls") > 0), F.round(F.col("crawls") / F.col("clicks"), 9)).alias("per_visitor"),
    )


def one_in(ratio: Column) -> Column:
    """A ratio in words: 1 in N."""
    return F.when(ratio > 0, F.concat(F.lit("1 in "), F.floor(1 / ratio + 0.5).cast("string"))).otherwise("—")


def verified_share(verified: Column, spoofed: Column) -> Column:
    total = verified + spoofed
    return F.when(total > 0, F.concat(F.floor(100 * verified / total + 0.5).cast("string"), F.lit("%"))).otherwise("—")
