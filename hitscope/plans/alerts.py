"""Alert rules over enriched events, and the evaluation round with its cooldown state."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitscope.plans.panels import Panels, broken, genuine, hits, is_ai, n

LEAST_HITS, BASE_HOURS, MOST_SUBJECTS, KEPT_STATE = 20, 24 * 7 - 1, 20, 1000


def _after(p: Panels, delta: dt.timedelta):
    return F.col("ts") > F.lit(p.as_of - delta).cast("timestamp_ntz")


def _from(p: Panels, delta: dt.timedelta):
    return F.col("ts") >= F.lit(p.as_of - delta).cast("timestamp_ntz")


def _now(p: Panels) -> DataFrame:
    return p._site(p.events).filter(F.col("ts") <= F.lit(p.as_of).cast("timestamp_ntz"))


def spike(p: Panels, factor: float = 3.0) -> DataFrame:
    """One row if the last hour's genuine AI hits are many, and over factor times the week's hourly mean."""
    real = _now(p).filter(is_ai() & genuine() & _after(p, dt.timedelta(days=7)))
    last = _after(p, dt.timedelta(hours=1))
    got = real.agg(n(last).alias("last_hour"), F.round(n(~last) / F.lit(BASE_HOURS), 9).alias("avg_hour"))
    return got.filter((F.col("last_hour") >= LEAST_HITS) & (F.col("avg_hour") > 0) & (F.col("last_hour") > factor * F.col("avg_hour")))


def new_bots(p: Panels, minutes: int) -> DataFrame:
    """Agents seen, unforged, in the window, and never in the 30 days before it (forged sightings count there).
    Nothing if there are no earlier events at all."""
    window = dt.timedelta(minutes=minutes)
    rows = _now(p)
    earlier = rows.filter(_from(p, dt.timedelta(days=30)) & ~_from(p, window))
    now = rows.filter(_from(p, window) & genuine() & (F.col("bot_id") != ""))
    known = earlier.filter("bot_id != ''").select("bot_id").distinct()
    some = earlier.limit(1).select(F.lit(True).alias("some"))
    found = now.groupBy("bot_id").agg(hits().alias("hits")).join(known, "bot_id", "left_anti")
    return found.join(F.broadcast(some), F.col("some"), "left_semi").orderBy(F.desc("hits"), "bot_id").limit(MOST_SUBJECTS)


def spoofed(p: Panels, minutes: int) -> DataFrame:
    rows = _now(p).filter(~genuine() & _after(p, dt.timedelta(minutes=minutes)))
    return rows.groupBy("bot_id").agg(hits().alias("hits")).orderBy(F.desc("hits"), "bot_id").limit(MOST_SUBJECTS)


def broken_citations(p: Panels, minutes: int) -> DataFrame:
    """Pages on which genuine retrieval agents now fail, but succeeded at some time in the last 31 dates."""
    retrieval = F.col("actor_type").isin("ai_fetcher", "ai_search") & genuine()
    fine = (
        p._site((p.rollups or {})["daily_page_ai_stats"]).filter(retrieval & (F.col("date") > F.lit(p.as_of.date() - dt.timedelta(days=31))))
        .groupBy("path_group").agg(F.sum("hits").alias("h"), F.sum("errors").alias("e")).filter("h > e").select("path_group")
    )
    bad = _now(p).filter(retrieval & broken() & _after(p, dt.timedelta(minutes=minutes)))
    return bad.join(fine, "path_group", "left_semi").groupBy("path_group").agg(hits().alias("errors")).orderBy(F.desc("errors"), "path_group").limit(MOST_SUBJECTS)


@dataclass
class Round:
    """Evaluates the enabled rules of each site. State: rule|site|subject to the time last delivered.

    A subject within its cooldown is silent; state is written only for what was delivered; a rule or delivery that
    fails leaves the others alone. `running` keeps rounds from overlapping.
    """

    deliver: Callable[[dict[str, Any]], bool]
    rules: list[str] = field(default_factory=lambda: ["spike", "new_bot", "spoof", "broken_citation"])
    minutes: int = 10
    factor: float = 3.0
    cooldown: dt.timedelta = dt.timedelta(hours=6)
    state: dict[str, str] = field(default_factory=dict)
    running: bool = False
    failures: list[str] = field(default_factory=list)

    def _subjects(self, rule: str, p: Panels) -> list[tuple[str, dict[str, Any]]]:
        """At most MOST_SUBJECTS, by the rules' own limit."""
        if rule == "spike":
            return [("ai", r.asDict()) for r in spike(p, self.factor).collect()]
        if rule == "new_bot":
            return [(r["bot_id"], r.asDict()) for r in new_bots(p, self.minutes).collect()]
        if rule == "spoof":
            return [(r["bot_id"], r.asDict()) for r in spoofed(p, self.minutes).collect()]
        if rule == "broken_citation":
            return [(r["path_group"], r.asDict()) for r in broken_citations(p, self.minutes).collect()]
        raise ValueError(f"unknown rule {rule!r}")

    def tick(self, sites: dict[str, Panels], now: dt.datetime) -> list[dict[str, Any]]:
        if self.running:
            return []
        self.running = True
        sent = []
        try:
            self.state = prune(self.state, now, self.cooldown)
            for site, panels in sites.items():
                for rule in self.rules:
                    try:
                        for subject, detail in self._subjects(rule, panels):
                            key = f"{rule}|{site}|{subject}"
                            if key in self.state:
                                continue
                            event = {"rule": rule, "site": site, "subject": subject, "detail": json.loads(json.dumps(detail, default=str)), "at": now.isoformat()}
                            if self.deliver(event):
                                self.state[key] = now.isoformat()
                                sent.append(event)
                    except Exception as e:
                        self.failures.append(f"{rule}|{site}: {e}")
        finally:
            self.running = False
        return sent


def prune(state: dict[str, str], now: dt.datetime, cooldown: dt.timedelta) -> dict[str, str]:
    """State without entries past their cooldown or unreadable, the newest KEPT_STATE of them."""
    live = {}
    for key, at in state.items():
        try:
            if now - dt.datetime.fromisoformat(at) < cooldown:
                live[key] = at
        except ValueError:
            continue
    return dict(sorted(live.items(), key=lambda kv: kv[1], reverse=True)[:KEPT_STATE])


def post_json(url: str, timeout: float = 10.0, retries: int = 1) -> Callable[[dict[str, Any]], bool]:
    """A deliver function: POSTs the event as JSON; whether a 2xx came back."""
    import urllib.error
    import urllib.request

    def send(event: dict[str, Any]) -> bool:
        for _ in range(retries + 1):
            try:
                request = urllib.request.Request(url, json.dumps(event).encode(), {"content-type": "application/json"})
                with urllib.request.urlopen(request, timeout=timeout) as r:
                    if 200 <= r.status < 300:
                        return True
            except (urllib.error.URLError, TimeoutError, OSError):
                continue
        return False

    return send
