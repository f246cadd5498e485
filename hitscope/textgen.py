"""Texts made from the registry: robots.txt, llms.txt and a service unit."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitscope.registry import generic_identity

CATEGORIES = {"ai_training": "training", "ai_search": "search", "ai_fetcher": "fetch"}


def robots_tokens(registry: DataFrame, policy: dict[str, str]) -> DataFrame:
    """One row per product token of an AI agent: token, denied. A token that several agents share is denied if any is."""
    clean = F.filter(F.transform("ua_patterns", lambda p: F.regexp_replace(p, "/$", "")), lambda p: p.rlike(r"\A[A-Za-z0-9_-]+\z"))
    denied = F.lit(False)
    for actor, key in CATEGORIES.items():
        denied = denied | ((F.col("actor_type") == actor) & F.lit(policy.get(key) == "deny"))
    named = registry.filter(F.col("actor_type").isin(*CATEGORIES) & ~generic_identity(F.col("ua_patterns"))).select("bot_id", F.get(clean, 0).alias("token"), denied.alias("denied"))
    return (
        named.filter(F.col("token").isNotNull()).groupBy(F.lower("token").alias("k"))
        .agg(F.min_by("token", "bot_id").alias("token"), F.bool_or("denied").alias("denied")).select("token", "denied")
    )


def robots_txt(registry: DataFrame, policy: dict[str, str]) -> str:
    """A suggested robots.txt: blocked tokens, then allowed ones, each in ASCII order."""
    rows = robots_tokens(registry, policy).collect()  # a registry's tokens, a few thousand at most
    lines = ["# Suggested policy for AI crawlers, by category; serve at /robots.txt", ""]
    for denied, title, rule in ((True, "# Blocked", "Disallow: /"), (False, "# Allowed", "Allow: /")):
        tokens = sorted(r["token"] for r in rows if r["denied"] == denied)
        if tokens:
            lines += [title, *(f"User-agent: {t}" for t in tokens), rule, ""]
    return "\n".join(lines).rstrip() + "\n"


def llms_txt(domain: str) -> str:
    """A skeleton llms.txt for a site; the domain may come with scheme, path or port."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", domain.strip().lower())
    host = re.split(r"[/?#]", host)[0].rsplit("@", 1)[-1].rstrip(".") or "example.com"
    return (
        f"# {host}\n\n> One or two sentences on what this site offers and for whom.\n\n## Key pages\n\n"
        f"- [Home](https://{host}/): what the site is about\n- [About](https://{host}/about): who is behind it\n\n## Optional\n\n- [Archive](https://{host}/archive): older material\n"
    )


def unit_text(options: dict[str, Any]) -> str:
    """A service unit that tails a log: command, path, format, site."""
    quote = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"').replace("%", "%%") + '"'
    args = " ".join(quote(options[k]) for k in ("command", "path", "format", "site") if k in options)
    return f"[Unit]\nDescription=Request log tail\nAfter=network-online.target\n\n[Service]\nExecStart={args}\nRestart=always\nRestartSec=5\n\n[Install]\nWantedBy=multi-user.target\n"
