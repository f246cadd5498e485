"""Where intermediate tables go."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it in spark.checkpoint.dir.

    Where it names none, a temporary folder serves a session whose executors are this machine's threads; on a cluster
    that is an error, as executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="hitscope-")
    return f"file://{_local[app]}"
