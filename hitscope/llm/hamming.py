"""Multi-index hashing of 64-bit fingerprints: two segments of 32 bits, each looked up with its ball of one bit."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes whose bits are counted together.
HASHES_AT_ONCE = 1 << 16


def majority(parts: Iterable[np.ndarray]) -> int:
    """The signed 64-bit SimHash of unsigned hashes, given in parts: a bit is set if over half of them have it."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _links(radius: int):
    """One table entry: members have its segment value, visitors differ from it in one bit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        own = pdf["own"].to_numpy(bool)
        members, visitors = np.unique(fp[own]), fp[~own]
        a, b = [], []
        group = np.full(len(members), -1, np.int64)
        left = np.arange(len(members))
        n_groups = 0
        while len(left):
            front = [left[0]]
            group[left[0]] = n_groups
            left = left[1:]
            while front and len(left):
                x = front.pop()
                near = np.bitwise_count(members[left] ^ members[x]) <= radius
                hit = left[near]
                if len(hit):
                    a.extend(members[hit])
                    b.extend([members[x]] * len(hit))
                    group[hit] = n_groups
                    front.extend(hit)
                    left = left[~near]
            n_groups += 1
        step = max(1, 4_000_000 // max(1, len(members)))
        for i in range(0, len(visitors), step):
            v = visitors[i : i + step]
            at, to = np.nonzero(np.bitwise_count(v[:, None] ^ members[None, :]) <= radius)
            if len(at):
                _, one = np.unique(at * n_groups + group[to], return_index=True)
                a.extend(v[at[one]])
                b.extend(members[to[one]])
        return pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(b, np.uint64).view(np.int64)})

    return run


def link(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect exactly what links at `radius` (3 at most) connect."""
    if radius > 3:
        raise ValueError("two segments with balls of one bit find pairs of at most 3 differing bits")
    return met(fps, radius)


def met(fps: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) at `radius` or fewer bits: they connect all pairs at 3 or fewer, and those
    beyond that have a segment that differs in one bit at most."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    both = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("segment"), low.alias("value")), F.struct(F.lit(1).alias("segment"), high.alias("value")))).alias("s")).select("fp", "s.*")
    table = both.withColumn("own", F.lit(True))
    flips = F.array(*[F.lit(1 << k) for k in range(32)])
    ball = both.select("fp", "segment", F.explode(F.transform(flips, lambda x: F.col("value").bitwiseXOR(x))).alias("value"))
    visits = ball.join(both.select("segment", "value").distinct(), ["segment", "value"], "left_semi").withColumn("own", F.lit(False))
    shared = both.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"))
    met = visits.select("segment", "value").distinct()
    useful = shared.join(met.withColumn("met", F.lit(True)), ["segment", "value"], "left").filter((F.col("n") > 1) | F.col("met")).select("segment", "value")
    members = table.join(useful, ["segment", "value"], "left_semi")
    return members.unionByName(visits).groupBy("segment", "value").applyInPandas(_links(radius), "a long, b long")
