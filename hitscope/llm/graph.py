"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitscope.llm.common import materialize

#: Far over what the steps need (they halve the longest path); reaching it is an error, not a result.
MOST_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b: each node's neighbours (large: its larger ones; small: its smaller ones
    and itself) are linked to the least of its neighbours and itself. The least comes from a pre-aggregated
    minimum, so a node with very many neighbours is no single task's work."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        found = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return found.filter(F.col("a") != F.col("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    found = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return found.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to (node, root) for every node that has an edge to another; root: the least node reachable.

    Each round is written to the shared folder, so an executor's loss costs a round at most.
    """
    now = materialize(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seal = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = seal(now)
    for _ in range(MOST_STEPS):
        if not before[0]:
            break
        now = materialize(_star(_star(now, True), False), "edges")
        after = seal(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
