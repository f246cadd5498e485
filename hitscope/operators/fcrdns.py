"""Forward-confirmed reverse DNS from tables of observations, as executors ask no name server.

What was seen of names and addresses counts from when it was seen until it is seen anew, at most for its time to live.
A bot's address is confirmed if one of its names (PTR), seen then, ends in one of the vendor's suffixes and that name has
the address among its own (A, AAAA), seen then. An answer that says that there are no names, names of other owners
only, or names whose addresses are all known and others, make it spoofed. Whatever is not known or failed leaves it open.

Each interval is cut at the edges of BUCKET and stands under each bucket it touches, so that finding what held at a time is
an equality join on (key, bucket) with a check of the bounds, whatever the number of observations.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitscope.functions.ip import ip_key
from hitscope.operators.sessions import micros

#: Seconds that a verdict of name servers holds where the observation does not say, and those of a bucket.
TTL, BUCKET = 3600, 3600
#: What an observation says: there are names or addresses, there are none, or nobody knows.
FOUND, NEGATIVE, TRANSIENT = "found", "negative", "transient"

PTR = "ip string, seen timestamp_ntz, code string, names array<string>, ttl int"
ADDRESSES = "host string, kind string, seen timestamp_ntz, code string, addresses array<string>, ttl int"


def host_name(name: Column) -> Column:
    """A name in lower case without the dot at its end."""
    return F.regexp_replace(F.lower(name), r"\.$", "")


def has_suffix(host: Column, suffix: Column) -> Column:
    """Whether a host_name is under a suffix: with a dot ahead, below it; without, that name itself too."""
    plain = host_name(suffix)
    below = F.when(F.startswith(plain, F.lit(".")), plain).otherwise(F.concat(F.lit("."), plain))
    return F.endswith(host, below) | (host == plain)


def _bucket(ts: Column) -> Column:
    return F.floor(micros(ts) / (BUCKET * 1_000_000))


def intervals(seen: DataFrame, keys: list[str]) -> DataFrame:
    """Observations with `until` and a row for each bucket they hold in. Of several at one time, the last by their columns counts."""
    order = W.partitionBy(*keys).orderBy("seen")
    rest = [c for c in seen.columns if c not in (*keys, "seen")]
    one = seen.groupBy(*keys, "seen").agg(F.max(F.struct(*rest)).alias("_o")).select(*keys, "seen", "_o.*")
    end = F.col("seen") + F.make_dt_interval(secs=F.coalesce("ttl", F.lit(TTL)))
    held = one.withColumn("until", F.least(F.lead("seen").over(order), end)).filter(F.col("until") > F.col("seen"))
    return held.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("seen")), _bucket(F.col("until")))))


def outcomes(asked: DataFrame, ptr: DataFrame, addresses: DataFrame, bots: list[dict[str, Any]]) -> DataFrame:
    """(ip, bot_id, ts) of hits, PTR and ADDRESSES observations to (ip, bot_id, ts, outcome), a row for each distinct hit of
    a bot whose vendor has suffixes: verified, spoofed or transient."""
    suffixes = {e["bot_id"]: e["rdns_suffixes"] for e in bots if e["rdns_suffixes"]}
    hits = asked.select("ip", "bot_id", "ts").filter(F.col("bot_id").isin(*suffixes)).distinct()
    if not suffixes:
        return hits.withColumn("outcome", F.lit(TRANSIENT))
    table = F.create_map(*[x for b, s in suffixes.items() for x in (F.lit(b), F.array(*map(F.lit, s)))])
    named = intervals(ptr, ["ip"]).select("ip", "bucket", F.col("seen").alias("_from"), F.col("until").alias("_to"), F.col("code").alias("_code"), F.col("names").alias("_names"))
    now = lambda: (F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_to"))
    known = hits.withColumn("bucket", _bucket(F.col("ts"))).join(named, ["ip", "bucket"]).filter(now())
    mine = F.array_distinct(F.filter(F.transform("_names", lambda n: host_name(n)), lambda h: F.exists(table[F.col("bot_id")], lambda s: has_suffix(h, s))))
    known = known.select("ip", "bot_id", "ts", "bucket", "_code", F.when(F.col("_code") == FOUND, mine).alias("_hosts"))
    asked_of = known.filter(F.size("_hosts") > 0).select("ip", "bot_id", "ts", "bucket", F.explode("_hosts").alias("host"))
    forward = intervals(addresses.withColumn("host", host_name(F.col("host"))), ["host", "kind"]).select(
        "host", "bucket", "kind", F.col("seen").alias("_from"), F.col("until").alias("_to"), F.col("code").alias("_code"), F.transform("addresses", lambda a: ip_key(a)).alias("_keys")
    )
    # of each host asked for: whether the address is among its own, and whether both kinds of addresses are known
    answers = asked_of.join(forward, ["host", "bucket"]).filter(now()).groupBy("ip", "bot_id", "ts", "host").agg(
        F.max(F.coalesce((F.col("_code") == FOUND) & F.array_contains("_keys", ip_key(F.col("ip"))), F.lit(False))).alias("_is"),
        F.count_if(F.col("_code").isin(FOUND, NEGATIVE)).alias("_known"),
    )
    of_hit = asked_of.join(answers, ["ip", "bot_id", "ts", "host"], "left").groupBy("ip", "bot_id", "ts").agg(
        F.max(F.coalesce("_is", F.lit(False))).alias("_verified"), F.min(F.coalesce("_known", F.lit(0)) >= 2).alias("_all")
    )
    verdict = (
        F.when(F.col("_code") == NEGATIVE, "spoofed").when(F.coalesce(F.col("_code") != FOUND, F.lit(True)), TRANSIENT).when(F.size("_hosts") == 0, "spoofed")
        .when(F.col("_verified"), "verified").when(F.col("_all"), "spoofed").otherwise(TRANSIENT)
    )
    told = known.join(of_hit, ["ip", "bot_id", "ts"], "left").select("ip", "bot_id", "ts", verdict.alias("outcome"))
    return hits.join(told, ["ip", "bot_id", "ts"], "left").withColumn("outcome", F.coalesce("outcome", F.lit(TRANSIENT)))
