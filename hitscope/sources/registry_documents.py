"""The registry from its three documents: a list of declared AI crawlers, a list of crawler patterns, and own entries."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from hitscope import registry


def document(spark: SparkSession, path: str, snapshot: str | None = None) -> Any:
    """A JSON document, or its snapshot where it cannot be read or is no JSON; both lie where Spark can read."""
    for place in [path, *([snapshot] if snapshot else [])]:
        try:
            return json.loads(spark.read.text(place, wholetext=True).first()[0])
        except (PySparkException, ValueError, TypeError) as e:
            problem = e
    raise ValueError(f"neither {path} nor a snapshot of it can be read") from problem


def compiled(spark: SparkSession, robots: Any = None, crawlers: Any = None, own: Any = None, taxonomy: DataFrame | None = None) -> DataFrame:
    """Documents (each may be missing) to the merged registry.

    robots: {name: {operator, function, ...}}; crawlers: [{pattern, url, tags}]; own: registry entries.
    """
    parts: dict[str, DataFrame] = {}
    if robots:
        rows = [(name, e.get("operator"), e.get("function")) for name, e in robots.items()]
        parts["robots"] = registry.from_robots_list(spark.createDataFrame(rows, "name string, operator string, function string"), taxonomy)
    if crawlers:
        rows = [(e.get("pattern"), e.get("url"), e.get("tags")) for e in crawlers if e.get("pattern")]
        parts["crawlers"] = registry.from_crawler_list(spark.createDataFrame(rows, "pattern string, url string, tags array<string>"), taxonomy)
    if own:
        parts["custom"] = registry.frame(spark, own)
    if not parts:
        return registry.frame(spark, [])
    return registry.compile_registry(**parts)


def build(spark: SparkSession, robots: str, crawlers: str, own: str, snapshots: dict[str, str] | None = None) -> DataFrame:
    """The registry from the three documents' paths; snapshots: a stand-in path by the name of a document."""
    held = snapshots or {}
    return compiled(spark, document(spark, robots, held.get("robots")), document(spark, crawlers, held.get("crawlers")), document(spark, own, held.get("own")))
