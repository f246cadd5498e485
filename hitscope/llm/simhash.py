"""SimHash near-dedup by multi-index hashing.

A document's 64-bit fingerprint has a bit set if over half of its shingles' hashes have it. Two fingerprints link
at RADIUS or fewer differing bits. With two 32-bit segments, a linked pair differs by at most one bit in one of
them, so each distinct fingerprint stands in a table under both of its segments, and looks up, in each, the ball
of its own segment and the 32 values one bit away. What is fetched is verified on all 64 bits. Within one table
entry, the members are joined into as few links as connect them (a grown search, not all pairs), and each visitor
from one bit away is linked once to each connected group of members it truly links to.

Defined cases: null and blank texts have no words and the fingerprint zero, which links like any other; fewer
words than a shingle are one shingle; repeated rows share a fingerprint; a null doc_id is never a component's
smallest unless the component has no other; extra columns are dropped by `fingerprints`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitscope.llm.common import beside, documents, materialize
from hitscope.llm.graph import connected_components
from hitscope.llm.hamming import HASHES_AT_ONCE, link, majority
from hitscope.llm.nearcopies import one_each, row_hashes

SHINGLE, SEED, RADIUS = 3, 42, 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(p, SEED) for p in parts[i : i + HASHES_AT_ONCE]], np.uint64) for i in range(0, len(parts), HASHES_AT_ONCE))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to (doc_id, fp)."""
    return _with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle)


def _with_fingerprint(rows: DataFrame, shingle: int) -> DataFrame:
    """fp in place of text."""
    return beside(rows, ["text"], [("fp", T.LongType(), pa.int64())], lambda texts: ([fingerprint(t, shingle) for t in texts],), dropped=("text",))


def components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) to (doc_id, fp, component_id): one row per row of docs."""
    marked = materialize(fingerprints(docs, shingle), "simhash")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected_components(link(least.select("fp"), radius))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with its own columns: that of the smallest doc_id, nulls last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_hashes(docs), "text")
    marked = materialize(_with_fingerprint(rows, shingle), "simhash")
    roots = connected_components(link(marked.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    return one_each(docs, marked.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = components(documents(spark, sf_dir))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
