"""Sharding into parts of near equal bytes by Karmarkar-Karp differencing.

Documents with equal texts form a group that is never divided. Groups are spread over buckets by hash; each
bucket is differenced on its own (a heap of partial partitions, the two of largest spread combined in opposite
order), which leaves one partial partition, `shards` sums, per bucket. Those few sums are differenced again,
and each bucket's parts are renamed accordingly. No task sees more than its bucket of groups.

Defined cases: a null text counts as empty (and is grouped with empty texts); repeated rows are placed together;
the text is dropped, extra columns are kept unless they bear an output's name; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitscope.llm.common import documents, materialize, numbered, unused

OVERHEAD = 8
BUCKETS, GROUPS_A_BUCKET = 256, 200_000
UNITS, ROWS_A_UNIT = 256, 1_000_000


def difference(vectors: list[np.ndarray]) -> list[np.ndarray]:
    """For each vector of k part sizes, the place each of its parts gets so that the k totals come near each other."""
    k, n = len(vectors[0]), len(vectors)
    sums: list[np.ndarray] = []
    kids: list[tuple[int, int] | None] = [None] * n
    turns: list[np.ndarray] = []
    for v in vectors:
        order = np.argsort(-v, kind="stable")
        sums.append(v[order])
        turns.append(order)
    heap = [(-(int(s[0]) - int(s[-1])), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    perms: list[np.ndarray | None] = [None] * n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums.append(both)
        sums[a] = sums[b] = None  # type: ignore[call-overload]
        kids.append((a, b))
        perms.append(order.astype(np.int16))
        heapq.heappush(heap, (-(int(both[0]) - int(both[-1])), len(sums) - 1))
    # from the root down: where does sorted place j of a node end up?
    where: dict[int, np.ndarray] = {len(sums) - 1: np.arange(k, dtype=np.int16)}
    out: list[np.ndarray | None] = [None] * n
    for node in range(len(sums) - 1, -1, -1):
        at = where.pop(node)
        pair = kids[node]
        if pair is None:
            place = np.empty(k, np.int16)
            place[turns[node]] = at
            out[node] = place
            continue
        before = np.empty(k, np.int16)
        before[perms[node]] = at  # place of the unsorted sums
        where[pair[0]], where[pair[1]] = before, before[::-1]
    return out  # type: ignore[return-value]


def _bucket(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_bytes", "group"], ascending=[False, True], ignore_index=True)
        sizes = pdf["group_bytes"].to_numpy(np.int64)
        eye = []
        for s in sizes:
            v = np.zeros(shards, np.int64)
            v[0] = s
            eye.append(v)
        pdf["part"] = np.fromiter((p[0] for p in difference(eye)), np.int32, len(eye))
        return pdf[["group", "bucket", "part", "group_bytes"]]

    return run


def shard_by_bytes(docs: DataFrame, shards: int = 24, text: str = "text") -> DataFrame:
    """Adds size, text_crc32, shard and slot (gapless from 0 within a shard) to docs."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = unused("_group", docs.columns)
    sized = (
        docs.drop("size", "text_crc32", "shard", "slot")
        .withColumn("size", (F.octet_length(raw) + OVERHEAD).cast("long"))
        .withColumn("text_crc32", F.crc32(raw))
        .withColumn(key, F.unhex(F.md5(raw)))
        .drop(text)
    )
    groups = sized.groupBy(F.col(key).alias("group")).agg(F.sum("size").alias("group_bytes"))
    groups = materialize(groups, "shard-groups")
    n_groups = groups.count()
    buckets = max(BUCKETS, n_groups // GROUPS_A_BUCKET)
    local = materialize(
        groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
        .groupBy("bucket").applyInPandas(_bucket(shards), "group binary, bucket int, part int, group_bytes long"),
        "shard-parts",
    )
    # one row per bucket and part: bounded by the number of buckets, not of documents
    sums = local.groupBy("bucket", "part").agg(F.sum("group_bytes").alias("b")).collect()
    names = sorted({r["bucket"] for r in sums})
    row_of = {b: i for i, b in enumerate(names)}
    table = np.zeros((max(1, len(names)), shards), np.int64)
    for r in sums:
        table[row_of[r["bucket"]], r["part"]] = r["b"]
    places = difference(list(table))
    spark = docs.sparkSession
    renamed = spark.createDataFrame(
        [(int(b), int(p), int(places[i][p])) for b, i in row_of.items() for p in range(shards)], "bucket int, part int, shard int"
    )
    placed = local.join(F.broadcast(renamed), ["bucket", "part"]).select(F.col("group").alias(key), "shard")
    out = sized.join(placed, key).drop(key)
    n_units = max(UNITS, n_groups // ROWS_A_UNIT)
    unit = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_units)).cast("int")
    return numbered(out, "shard", unit, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
