"""User-agent classification as one Column expression.

Order of the stages: strong tokens (any case; leftmost, then longest), patterns (case-sensitive, in registry order,
those with capture groups last), consumer devices that look like bots, weak tokens, generic signs of automation, human.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitscope.functions.ip import let
from hitscope.registry import GENERIC_IDENTITIES, has_generic_identity

META = re.compile(r"[\\^$.*+?()\[\]{}|]")

#: Signs of automation that name nobody. Fixed values.
GENERIC_SIGNS = [
    r"\bbot\b", r"bot[/;:,\s)]", r"bot$", "crawl", "spider", "scrap", "python", "aiohttp", "httpx", "curl/", "wget/", "libwww", "java/", "okhttp", "httpclient",
    "node-fetch", "axios/", "go-http-client", "headlesschrome", "phantomjs", "puppeteer", "playwright", "lighthouse", "feedparser", "feedfetcher",
    "monitoring", "uptime", "probe",
]
DEVICES = "(?i)cubot"


Result = tuple[str, str, str]


def _result(r: Result) -> Column:
    return F.struct(F.lit(r[0]).alias("actor_type"), F.lit(r[1]).alias("bot_id"), F.lit(r[2]).alias("operator"))


def _of(entry: dict[str, Any]) -> Result:
    return entry["actor_type"], entry["bot_id"], "" if entry["operator"] == "unknown" else entry["operator"]


def stages(bots: list[dict[str, Any]]) -> tuple[dict[str, Result], list[tuple[str, Result]], dict[str, Result]]:
    """Strong tokens, patterns in their order, weak tokens, each with what it stands for. The first entry with a token has it."""
    strong: dict[str, Result] = {}
    weak: dict[str, Result] = {}
    patterns: list[tuple[bool, str, Result]] = []
    for e in bots:
        for p in e["ua_patterns"]:
            plain = p.replace("\\/", "/")
            if META.search(plain):
                try:
                    groups = re.compile(p).groups
                except re.error:  # a pattern of another dialect is passed over
                    continue
                patterns.append((groups > 0, p, _of(e)))
            elif len(plain) < 4 or plain.lower() in GENERIC_IDENTITIES:
                degraded = has_generic_identity(e) and e["actor_type"].startswith("ai_")
                weak.setdefault(plain.lower(), ("other_bot", "", "") if degraded else _of(e))
            else:
                strong.setdefault(plain.lower(), _of(e))
    return strong, [(p, r) for _, p, r in sorted(patterns, key=lambda x: x[0])], weak


def _java(pattern: str) -> str:
    """The pattern with word boundaries between ASCII word characters and all others, as in the dialect that registries are written in."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def _literal(tokens: list[str]) -> str:
    return "|".join(r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in tokens)


def _lookup(ua: Column, owners: dict[str, Result]) -> Column:
    """The result of the leftmost, longest token in ua; null if there is none."""
    if not owners:
        return F.lit(None).cast("struct<actor_type:string,bot_id:string,operator:string>")
    longest = sorted(owners, key=lambda t: (-len(t), t))
    found = F.lower(F.regexp_extract(ua, f"(?i)({_literal(longest)})", 1))
    table = F.create_map(*[x for t in owners for x in (F.lit(t), _result(owners[t]))])
    return let(found, lambda f: F.when(f != "", F.try_element_at(table, f)))


def classify(ua: Column, bots: list[dict[str, Any]]) -> Column:
    """struct<actor_type, bot_id, operator>; unknown is ''. For registries of some dozens of entries; `agent_index` has the same for long ones."""
    strong, patterns, weak = stages(bots)
    other, human = _result(("other_bot", "", "")), _result(("human", "", ""))
    blank = F.trim(F.coalesce(ua, F.lit(""))).isin("", "-")
    return F.coalesce(
        F.when(blank, other), _lookup(ua, strong), *[F.when(ua.rlike(_java(p)), _result(result)) for p, result in patterns],
        F.when(ua.rlike(DEVICES), human), _lookup(ua, weak),
        F.when(ua.rlike("(?i)" + "|".join(map(_java, GENERIC_SIGNS))), other), human,
    )
