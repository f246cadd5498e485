"""Partials of a rollup merged in place, log-structured, while others read and write.

A table is a folder: each micro-batch writes its partial to batch=<id>, compaction writes runs, and manifests, numbered
upward, say which runs count and up to which batch they cover. A reader takes the newest manifest, its runs, and the
batches beyond them, so it always sees each batch once: one that is replayed after it was merged is covered and not read.
FANOUT folders of a tier are merged into one of the next, so that each row is rewritten a logarithmic number of times and
the number of folders stays small.

A new manifest appears whole or not at all, by a rename that never replaces one; of two compactions at once, one gives way.
What a manifest no longer names stays until KEPT newer manifests exist, so that readers that started earlier are unharmed.
Batches may be merged once their stream has gone on to the next one, as only the newest batch is ever replayed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FANOUT, KEPT = 8, 2
Merge = Callable[[DataFrame], DataFrame]


class Folder:
    """Files of the shared store, by Hadoop's own interface."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def publish(self, name: str, text: str) -> bool:
        """Writes a small file whole; False if there is one already."""
        self._fs.mkdirs(self._at("_manifest"))
        draft = self._at(f"_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(draft, self._at(name)):
            self._fs.delete(draft, False)
            return False
        return True


@dataclass
class Manifest:
    version: int
    covered: int
    runs: list[dict[str, Any]]


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest; version 0 covers nothing."""
    versions = [int(n.removesuffix(".json")) for n in Folder(spark, path).names("_manifest") if n.endswith(".json") and not n.startswith(".")]
    if not versions:
        return Manifest(0, -1, [])
    text = "".join(r[0] for r in spark.read.text(_file(path, max(versions)), wholetext=True).collect())
    got = json.loads(text)
    return Manifest(max(versions), got["covered"], got["runs"])


def _file(path: str, version: int) -> str:
    return f"{path}/_manifest/{version:09d}.json"


def _batches(folder: Folder, beyond: int) -> list[int]:
    ids = [int(n.removeprefix("batch=")) for n in folder.names() if n.startswith("batch=")]
    return sorted(i for i in ids if i > beyond)


def parts(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up the table now."""
    m = manifest(spark, path)
    return [f"{path}/{r['name']}" for r in m.runs] + [f"{path}/batch={i}" for i in _batches(Folder(spark, path), m.covered)]


def read(spark: SparkSession, path: str, merge: Merge) -> DataFrame:
    """The table: all its partials, merged."""
    return merge(spark.read.parquet(*parts(spark, path)))


def compact(spark: SparkSession, path: str, merge: Merge, upto: int, fanout: int = FANOUT) -> bool:
    """Merges batches up to `upto`, and then full tiers, if there are enough of them. Whether a manifest was published."""
    folder, now = Folder(spark, path), manifest(spark, path)
    batches = [i for i in _batches(folder, now.covered) if i <= upto]
    if len(batches) < fanout:
        return False
    runs = list(now.runs)
    taken, tier = [f"batch={i}" for i in batches], 1
    while len(same := [r for r in runs if r["tier"] == tier]) >= fanout - 1:
        taken += [r["name"] for r in same]
        runs = [r for r in runs if r["tier"] != tier]
        tier += 1
    name = f"run-{uuid.uuid4().hex}"
    merge(spark.read.parquet(*[f"{path}/{n}" for n in taken])).write.parquet(f"{path}/{name}")
    after = {"covered": batches[-1], "runs": [*runs, {"name": name, "tier": tier}], "gone": taken}
    if not folder.publish(f"_manifest/{now.version + 1:09d}.json", json.dumps(after)):
        folder.delete(name)
        return False
    return True


def vacuum(spark: SparkSession, path: str, kept: int = KEPT) -> list[str]:
    """Deletes what manifests up to the newest but `kept` put out of use, and those manifests; says what."""
    folder, newest = Folder(spark, path), manifest(spark, path).version
    gone: list[str] = []
    for version in (int(n.removesuffix(".json")) for n in folder.names("_manifest") if n.endswith(".json") and not n.startswith(".")):
        if version <= newest - kept:
            text = "".join(r[0] for r in spark.read.text(_file(path, version), wholetext=True).collect())
            gone += json.loads(text)["gone"]
            for name in gone:
                folder.delete(name)
            folder.delete(f"_manifest/{version:09d}.json")
    return gone
