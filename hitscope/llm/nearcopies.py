"""Near copies by SimHash and multi-index hashing: all pairs with a Jaccard likeness of 0.8 or more over five words.

Each set of shingles has a SimHash of 64 bits. Two segments of it are looked up with their balls of one bit, and pairs
that meet there at RADIUS or fewer bits are verified by their whole sets. This misses no pair at 3 or fewer bits, but
many that are alike: they lie at 4 to 14 bits, and no index finds 14 of 64 bits short of comparing almost everything.

What the fingerprints miss is found exactly by indexing the set itself, one bit for each possible shingle: two sets of n
and m shingles are this alike if their vectors differ in at most (n + m) / 9 bits. As in multi-index hashing, the vector
is cut into segments, here ranges of the shingles' hashes, more of them than bits may differ, so that one segment at
least is equal in both; a table of segment contents proposes pairs, of which those that the fingerprints have not
proposed yet are verified whole.

An empty segment tells nothing and is left out. A set with too few filled ones for the argument is cut once more, by
other hashes, and so on; a pair of such sets meets there. How many segments there are depends on the size, in levels;
a set stands at the levels of all smaller sets it may be alike to. Nothing is missed.

Members of a table entry are compared in two steps, so that a large group of near copies is not compared pair by pair:
first all of them with one of them, in a few rounds, then, between what is not connected yet, all pairs. A pair is
first tried by parity bitmaps, whose difference is at most that of the sets, and then by the sets.

Defined cases: words are as in a SimHash (split at ASCII white space, ASCII letters in lower case); texts of fewer
words than a shingle are one shingle; null and blank texts have none and are copies of each other. Shingles and sets
are known by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitscope.llm.common import beside, giving_back, materialize
from hitscope.llm.graph import connected_components
from hitscope.llm.hamming import HASHES_AT_ONCE, majority, met

SHINGLE = 5
#: Bits up to which a pair of fingerprints that met is verified; sets this alike seldom lie further apart.
RADIUS = 14
#: The numbers of segments, one for each level.
COUNTS = sorted({int(np.ceil(2 ** (i / 2))) for i in range(64)})
#: Segments of each table part, which is sorted in one piece, and those that a task gathers before it deals them out.
PART_SEGMENTS, HELD_SEGMENTS = 1_000_000, 1_000_000
#: Sets a task remembers, so as to deal out the segments of equal ones once.
REMEMBERED = 100_000
#: Bits of a parity bitmap: at least one for each shingle, within these bounds.
LEAST_BITS, MOST_BITS = 64, 8192
#: Words of 64 bits of the bitmap that is compared while pairs are formed.
JOINED_WORDS = 16
#: Rounds of one member of each table entry against the others, until the pairs left are EASY times the rows. All pairs
#: that are left are then compared, after the last round too.
ROUNDS, EASY = 3, 4
#: Row keys up to which a table of them is broadcast (some 100 bytes each); a larger one is joined by a shuffle.
BROADCAST_KEYS = 500_000

U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, U)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    sums = np.zeros(n, U)
    for j in range(k):
        sums = _mixed(sums * U(0x9E3779B97F4A7C15) + hashed[j : j + n])
    return np.unique(sums)


def fingerprint(s: np.ndarray) -> int:
    """The signed SimHash of a set of shingles; no shingles: zero."""
    return majority(s[i : i + HASHES_AT_ONCE] for i in range(0, len(s), HASHES_AT_ONCE))


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes())


def level(n: int) -> int:
    """The place in COUNTS of a set of n shingles: somewhat more segments than the n // 4 bits that may differ from a larger one."""
    return bisect_right(COUNTS, 115 * (n // 4) // 100)


def largest(at: int) -> int:
    """The largest size at a level."""
    return 4 * ((100 * COUNTS[at] - 1) // 115) + 3


def signatures(s: np.ndarray) -> np.ndarray:
    """Hashes of the filled segments of a set, at all its levels."""
    n = len(s)
    if not n:
        return np.empty(0, U)
    out, own = [], level(n)
    for at in range(level(-(-4 * n // 5)), own + 1):
        count = U(COUNTS[at])
        may_differ = n // 4 if at == own else (n + largest(at)) // 9
        salt, filled = 0, 0
        while filled <= may_differ:
            x = np.sort(_mixed(s + U(0x9E3779B97F4A7C15 * salt % 2**64))) if salt else s
            segment = ((x >> U(32)) * count) >> U(32)
            first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            place = segment[first] * U(0xD6E8FEB86659FD93) + U((COUNTS[at] * 0xBF58476D1CE4E5B9 + salt) % 2**64)
            out.append(_mixed(np.add.reduceat(x, first) + _mixed(place)))
            filled = len(first)
            salt += 1
    return np.concatenate(out)


def parities(s: np.ndarray, bits: int = 0) -> bytes:
    """A bitmap: whether the number of shingles that hash to a place is odd; bits 0: as many as suit the set."""
    bits = bits or min(max(LEAST_BITS, 1 << max(0, len(s) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many places two parity bitmaps differ; the longer one is folded first."""
    size = 4 * (len(x) + len(y))
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    for _ in range(abs(len(x).bit_length() - len(y).bit_length())):
        size = 4 * max(len(x), len(y))
        x, y = x[: size // 8], y[: size // 8]
        a, b = (v >> size ^ v & (1 << size) - 1 if v.bit_length() > size else v for v in (a, b))
    return (a ^ b).bit_count()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def row_hashes(docs: DataFrame) -> list[Column]:
    """What a row is known by: two hashes of all its columns. Maps, which have no hash, count as JSON."""
    own = lambda f: F.col(f"`{f.name}`")
    every = [F.to_json(F.struct(own(f))) if "map<" in f.dataType.simpleString() else own(f) for f in docs.schema.fields]
    return [F.xxhash64(*every).alias("_r"), F.xxhash64(F.lit(7), *every).alias("_q")]


def _small(keys: DataFrame) -> DataFrame:
    """keys, stored, with a hint how to join them."""
    kept = materialize(keys, "keys")
    return kept.hint("broadcast" if kept.count() <= BROADCAST_KEYS else "merge")


def one_each(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """One row of docs for each root, with its own columns. marked: (doc_id, _r, _q, root) for each row; of a root, the
    row of the smallest doc_id stays, nulls last, then that of the smallest hash; of wholly equal rows, one."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_r", "_q")
    kept = marked.groupBy("root").agg(F.min(order).alias("o")).select("o._r", "o._q", F.lit(True).alias("kept"))
    rows = marked.groupBy("_r", "_q").agg(F.count(F.lit(1)).alias("n")).join(kept, ["_r", "_q"], "left")
    others = _small(rows.filter("kept is null or n > 1").select("_r", "_q", F.col("kept").isNotNull().alias("several")))
    keyed = docs.select(*row_hashes(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    single = keyed.join(others, ["_r", "_q"], "left_anti").select("_row")
    several = keyed.join(others.filter("several"), ["_r", "_q"], "left_semi").dropDuplicates(["_r", "_q"]).select("_row")
    return single.unionByName(several).select("_row.*")


def _index(docs: DataFrame) -> DataFrame:
    """(doc_id, _r, _q, h, n, fp) for each row: the set's hash, size and fingerprint."""

    def work(texts: list[str | None]) -> tuple[np.ndarray, list[int], list[int]]:
        sets = list(map(shingles, texts))
        return _signed(np.array(list(map(set_hash, sets)), U)), list(map(len, sets)), list(map(fingerprint, sets))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_hashes(docs), "text")
    count = (T.LongType(), pa.int64())
    return beside(rows, ["text"], [("h", *count), ("n", *count), ("fp", *count)], work, dropped=("text",))


def proposed(index: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of different sets (h) that meet by their fingerprints (fp). Of sets with one fingerprint the
    least meets those of other fingerprints, and its own."""
    sets = materialize(index.select("fp", "h").distinct(), "near-sets")
    least = materialize(sets.groupBy("fp").agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("n")), "near-fingerprints")
    own = sets.join(least.filter("n > 1"), "fp").select(F.col("h").alias("a"), F.col("least").alias("b"))
    of = lambda key: least.select(F.col("fp").alias(key), F.col("least").alias(f"{key}h"))
    others = met(least.select("fp"), RADIUS).join(of("a"), "a").join(of("b"), "b").select(F.col("ah").alias("a"), F.col("bh").alias("b"))
    both = own.unionByName(others).filter("a != b")
    return both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _dealt(parts: int):
    """Texts to rows of packed segments: the table part, the low bits of each segment's hash, its set."""

    def slices(g: np.ndarray, h: np.ndarray) -> pd.DataFrame:
        part = (g >> U(32)) * U(parts) >> U(32)
        order = np.argsort(part, kind="stable")
        low, h = g[order].astype(np.uint32), h[order]
        found, first = np.unique(part[order], return_index=True)
        ends = [*first[1:], len(h)]
        return pd.DataFrame({
            "part": found.astype(np.int32), "low": [low[i:j].tobytes() for i, j in zip(first, ends, strict=True)], "sets": [h[i:j].tobytes() for i, j in zip(first, ends, strict=True)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        g, h, size = [], [], 0
        for pdf in batches:
            for t in pdf["text"]:
                s = shingles(t)
                x = set_hash(s)
                if x in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(x)
                g.append(signatures(s))
                h.append(np.full(len(g[-1]), x, U))
                size += len(g[-1])
                if size >= HELD_SEGMENTS:
                    yield slices(np.concatenate(g), np.concatenate(h))
                    g, h, size = [], [], 0
        if size:
            yield slices(np.concatenate(g), np.concatenate(h))

    return giving_back(run)


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """A table part to its entries of two sets or more: (g, h, pivot), the least set of the entry being its pivot."""
    low, h = np.frombuffer(b"".join(pdf["low"]), np.uint32), np.frombuffer(b"".join(pdf["sets"]), np.int64)
    order = np.argsort(low)
    low, h = low[order], h[order]
    same = low[1:] == low[:-1]
    some = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    low, h = low[some], h[some]
    order = np.lexsort((h, low))
    low, h = low[order], h[order]
    changes = lambda x: np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]
    fresh = changes(low) | changes(h)
    low, h = low[fresh], h[fresh]
    new = changes(low)
    entry = np.cumsum(new) - 1
    several = np.bincount(entry)[entry] > 1 if len(entry) else new
    part = np.int64(pdf["part"].iloc[0]) << 32
    return pd.DataFrame({"g": part | low.astype(np.int64), "h": h, "pivot": h[new][entry]})[several]


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(h, n, bits, text, p) for rows (h, _r, _q); p: a bitmap of JOINED_WORDS words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = list(map(shingles, pdf["text"]))
            yield pd.DataFrame({"h": pdf["h"], "n": list(map(len, sets)), "bits": list(map(parities, sets)), "text": pdf["text"], "p": [np.frombuffer(parities(s, 64 * JOINED_WORDS), np.int64) for s in sets]})

    found = docs.select(*row_hashes(docs), "text").join(_small(rows), ["_r", "_q"]).select("h", "text").dropDuplicates(["h"])
    return found.mapInPandas(giving_back(run), "h long, n long, bits binary, text string, p array<long>")


@giving_back
def _may(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        near = [9 * differing(x, y) <= n + m and 4 * n <= 5 * m and 4 * m <= 5 * n for x, y, n, m in zip(pdf["x"], pdf["y"], pdf["n"], pdf["m"], strict=True)]
        yield pdf.loc[near, ["a", "b"]]


@giving_back
def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, other = None, np.empty(0, U)
    for pdf in batches:
        near = []
        for b, x, y in zip(pdf["b"], pdf["x"], pdf["y"], strict=True):
            if b != last:
                last, other = b, shingles(y)
            own = shingles(x)
            near.append(9 * len(np.intersect1d(own, other, assume_unique=True)) >= 4 * (len(own) + len(other)))
        yield pdf.loc[near, ["a", "b"]]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a likeness of 0.8 or more."""
    of = lambda key, *cols: texts.select(F.col("h").alias(key), *[F.col(c).alias(to) for c, to in cols])
    may = pairs.join(of("a", ("bits", "x"), ("n", "n")), "a").join(of("b", ("bits", "y"), ("n", "m")), "b").mapInPandas(_may, "a long, b long")
    return may.join(of("a", ("text", "x")), "a").join(of("b", ("text", "y")), "b").mapInPandas(_alike, "a long, b long")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (h, ...) with root."""
    return nodes.join(connected_components(links).withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, _r, _q, root) for each row of docs: rows of one root are connected by near copies."""
    index = materialize(_index(docs), "near-index")
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (2 * PART_SEGMENTS))
    dealt = docs.select("text").mapInPandas(_dealt(parts), "part int, low binary, sets binary")
    held = materialize(dealt.groupBy("part").applyInPandas(_entries, "g long, h long, pivot long"), "near-held")
    near = materialize(proposed(index), "near-proposed")
    needed = held.select("h").unionByName(near.select(F.col("a").alias("h"))).unionByName(near.select(F.col("b").alias("h")))
    rows = index.join(needed.distinct(), "h", "left_semi").groupBy("h").agg(F.min(F.struct("_r", "_q")).alias("o")).select("h", "o.*")
    texts = materialize(_texts(docs, rows), "near-texts")
    links = materialize(_verified(near, texts), "near-links")
    # the pivot is the least of its entry, as b is of a pair
    missed = held.filter("h != pivot").select(F.col("h").alias("a"), F.col("pivot").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    links = links.unionByName(materialize(_verified(missed, texts), "near-links"))
    # an entry of two sets is done with after its one pair
    apart = held.join(held.groupBy("g").count().filter("count > 2").select("g"), "g", "left_semi").select("g", "h")
    for r in range(ROUNDS):
        now = _roots(apart.select("g", "h"), links)
        several = now.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("g")
        apart = materialize(now.join(several, "g", "left_semi"), "near-apart")
        size = apart.groupBy("g", "root").count().groupBy("g").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
        n_rows, n_pairs = size.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0))).first()
        if r == ROUNDS - 1 or n_pairs <= EASY * n_rows:
            break
        pivots = apart.groupBy("g").agg(F.min(F.struct(F.xxhash64("h", F.lit(r)), "h", "root")).alias("p"))
        tried = apart.join(pivots, "g").filter(F.col("root") != F.col("p.root")).select(F.col("h").alias("a"), F.col("p.h").alias("b")).distinct()
        links = links.unionByName(materialize(_verified(tried, texts), "near-links"))
    if n_pairs:
        # sizes and bitmaps are compared inside the join, so that only pairs that may be alike become rows
        words = [F.get("p", F.lit(k)).alias(f"p{k}") for k in range(JOINED_WORDS)]
        sketched = materialize(apart.join(texts.select("h", "n", *words), "h"), "near-sketched")
        a, b = (sketched.select("g", *[F.col(c).alias(f"{c}{x}") for c in sketched.columns if c != "g"]) for x in "ab")
        differ = sum((F.bit_count(F.col(f"p{k}a").bitwiseXOR(F.col(f"p{k}b"))) for k in range(JOINED_WORDS)), F.lit(0))
        may = (F.col("roota") > F.col("rootb")) & (4 * F.col("na") <= 5 * F.col("nb")) & (4 * F.col("nb") <= 5 * F.col("na")) & (9 * differ <= F.col("na") + F.col("nb"))
        crossed = a.join(b.withColumnRenamed("g", "other"), (F.col("g") == F.col("other")) & may)
        pairs = crossed.select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct()
        links = links.unionByName(materialize(_verified(pairs, texts), "near-rest"))
    return _roots(index.select("doc_id", "_r", "_q", "h"), links).select("doc_id", "_r", "_q", "root")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with its own columns: that of the smallest doc_id."""
    return one_each(docs, materialize(marked(docs), "near-marked"))
