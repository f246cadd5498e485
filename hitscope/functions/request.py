"""Columns over a request: path, query, referer, visitor hash."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hitscope.functions.ip import let

#: Assistant, host pattern, path pattern ('' for any), in order. Fixed values.
REFERRERS = [
    ("chatgpt", r"(^|\.)chatgpt\.com$", ""), ("chatgpt", r"^chat\.openai\.com$", ""), ("perplexity", r"(^|\.)perplexity\.ai$", ""),
    ("gemini", r"^(gemini|bard)\.google\.com$", ""), ("claude", r"(^|\.)claude\.ai$", ""), ("copilot", r"^copilot\.microsoft\.com$", ""),
    ("copilot", r"(^|\.)bing\.com$", r"(?i)^/chat"), ("deepseek", r"(^|\.)deepseek\.com$", ""), ("grok", r"(^|\.)grok\.com$", ""),
    ("meta", r"^(www\.)?meta\.ai$", ""), ("you", r"^(www\.)?you\.com$", ""), ("mistral", r"^chat\.mistral\.ai$", ""),
]
#: utm_source values of assistants. Fixed values.
UTM_SOURCES = {
    "chatgpt.com": "chatgpt", "chatgpt": "chatgpt", "chat.openai.com": "chatgpt", "perplexity": "perplexity", "perplexity.ai": "perplexity", "gemini": "gemini",
    "claude": "claude", "claude.ai": "claude", "copilot": "copilot", "deepseek": "deepseek", "grok": "grok", "meta.ai": "meta", "you.com": "you", "mistral": "mistral",
}
_URL = r"^([a-z][a-z0-9+.-]*)://(?:[^/?#@\\]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\\]*)(?::(\d*))?([/\\][^?#]*)?"
_BARE = r"(?i)^[a-z0-9.-]+\.[a-z]{2,}(/|$)"


def upper(x: Column) -> Column:
    """The text in upper case. ASCII goes letter by letter, without the rules of other scripts."""
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.upper(x)).otherwise(F.translate(x, string.ascii_lowercase, string.ascii_uppercase))


def pathname(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def query(path: Column) -> Column:
    at = F.instr(path, "?")
    return F.when(at > 0, path.substr(at + 1, F.char_length(path))).otherwise(F.lit(""))


def path_group(path: Column) -> Column:
    """Segments that look like identifiers become :id; one trailing slash goes."""
    trimmed = F.when(F.endswith(path, F.lit("/")), path.substr(F.lit(1), F.char_length(path) - 1)).otherwise(path)
    # one pattern over the whole path: an identifier between slashes or the ends
    joined = F.regexp_replace(trimmed, r"(?<![^/])(?:[0-9]+|(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})|(?i:[0-9a-f]{8,})|[^/]{33,})(?![^/])", ":id")
    return F.when(joined == "", "/").otherwise(joined)


def _part(url: Column, k: int) -> Column:
    """Scheme 1, host 2, port 3, path 4 of a URL given in lower case (but the path)."""
    return F.regexp_extract(url, "(?i)" + _URL, k)


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), r"[\t\n\r]", "")


def referral_by_host(referer: Column) -> Column:
    """The assistant whose pages the referer is one of, or ''."""

    def as_url(r: Column) -> Column:
        bare = ~r.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & r.rlike(_BARE)
        return F.when(bare, F.concat(F.lit("https://"), r)).otherwise(r)

    def host_of(url: Column) -> Column:
        return F.struct(F.lower(_part(url, 1)).alias("scheme"), F.lower(_part(url, 2)).alias("host"), _part(url, 4).alias("path"))

    def by_host(u: Column) -> Column:
        named = F.lit("")
        for source, pattern, where in reversed(REFERRERS):
            hit = u["host"].rlike(pattern)
            named = F.when(hit & u["path"].rlike(where) if where else hit, source).otherwise(named)
        return F.when(u["scheme"].isin("http", "https") & (u["host"] != ""), named)

    return F.coalesce(let(let(let(_clean(F.coalesce(referer, F.lit(""))), as_url), host_of), by_host), F.lit(""))


def referral_by_utm(query_string: Column) -> Column:
    """The assistant that utm_source names, or ''."""
    utm = F.map_from_arrays(F.array(*map(F.lit, UTM_SOURCES)), F.array(*map(F.lit, UTM_SOURCES.values())))
    raw = F.regexp_extract(F.regexp_replace(query_string, r"^\?", ""), r"(?:^|&)utm_source=([^&]*)", 1)
    value = let(raw, lambda v: F.lower(F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit(" "))), v)))
    return F.when(F.contains(query_string, F.lit("utm_source=")), F.coalesce(F.try_element_at(utm, value), F.lit(""))).otherwise("")


def referral(referer: Column, query_string: Column) -> Column:
    """The assistant that sent the visit, or ''. The referer counts before utm_source."""
    return F.coalesce(F.nullif(referral_by_host(referer), F.lit("")), referral_by_utm(F.coalesce(query_string, F.lit(""))))


def referer_origin(referer: Column) -> Column:
    """scheme://host[:port] of an http(s) referer, lower-cased, without credentials or default port; else ''.

    Hosts beyond ASCII are left out ('') here; `idna_origin` gives their ASCII form.
    """

    def parts(r: Column) -> Column:
        return F.struct(F.lower(_part(r, 1)).alias("scheme"), F.lower(_part(r, 2)).alias("host"), F.regexp_replace(_part(r, 3), "^0+(?=.)", "").alias("port"))

    def origin(u: Column) -> Column:
        default = F.when(u["scheme"] == "http", "80").otherwise("443")
        text = F.concat(u["scheme"], F.lit("://"), u["host"], F.when(u["port"].isin("") | (u["port"] == default), "").otherwise(F.concat(F.lit(":"), u["port"])))
        ok = (
            u["scheme"].isin("http", "https") & u["host"].rlike(r"\A(\[[0-9a-f:.]+\]|[a-z0-9._~!$&'()*+,;=-]+)\z")
            & (F.coalesce(u["port"].try_cast("int"), F.lit(0)) <= 65535)
        )
        return F.when(ok, let(text, lambda t: F.when(F.char_length(t) <= 255, t)))

    return F.coalesce(let(let(_clean(F.coalesce(referer, F.lit(""))), parts), origin), F.lit(""))


def idna_origin(referer: Column) -> Column:
    """As referer_origin, for hosts of any script (the host goes through IDNA, in Arrow batches)."""
    @F.pandas_udf("string")
    def ascii_host(s: pd.Series) -> pd.Series:
        def one(h: str) -> str:
            try:
                return h if h.isascii() else h.encode("idna").decode()
            except UnicodeError:
                return ""

        return s.map(one)

    r = _clean(F.coalesce(referer, F.lit("")))
    host = _part(r, 2)
    return referer_origin(F.when(host.rlike(r"[^\x00-\x7F]"), F.replace(r, host, ascii_host(host))).otherwise(r))


def id_of(text: Column) -> Column:
    """The first 64 bits of a text's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def visitor_hash(ip: Column, day: Column, secret: str) -> Column:
    """A visitor's number for one UTC day."""
    return id_of(F.concat_ws(" ", F.lit(secret), F.date_format(day, "yyyy-MM-dd"), ip))
