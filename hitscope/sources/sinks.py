"""Where results go: event tables by month, CSV text, backups with a checked manifest, and what reads them back."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitscope.functions.ip import ip_key
from hitscope.operators import rollups
from hitscope.storage import shared_dir

CHUNK = 5000


#: Rows of a file of events: some 25 MB. A writer sorts them in one piece, 143 MB at most over 7.7 million rows.
ROWS_A_FILE = 250_000
LAYOUT = ["month", "site_id", "actor_type", "ts"]


def write_events(events: DataFrame, path: str, mode: str = "append", rows_a_file: int = ROWS_A_FILE) -> None:
    """Enriched events by month, in files of about as many rows, each a range of site, actor and time, so that readers
    skip files and row groups. They are stored as they come first: that tells how many files, thus writers, they need."""
    spark = events.sparkSession
    staged = f"{shared_dir(spark)}/hitscope/staged-{uuid.uuid4().hex}"
    dated = events.withColumn("month", F.date_format("ts", "yyyyMM"))
    dated.write.parquet(staged)
    held = spark.read.schema(dated.schema).parquet(staged)
    writers = max(1, -(-held.count() // rows_a_file))  # the count comes from the files' footers
    held.repartitionByRange(writers, *LAYOUT).sortWithinPartitions(*LAYOUT).write.mode(mode).partitionBy("month").parquet(path)
    _delete(spark, staged)


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def expire_events(spark: SparkSession, path: str, as_of: dt.datetime, keep: int = 13) -> list[str]:
    """Deletes the months of events that are wholly older than the retention, and says which."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    gone = rollups.expired_months(sorted(n.removeprefix("month=") for n in names if n.startswith("month=")), as_of, keep)
    for month in gone:
        _delete(spark, f"{path}/month={month}")
    return gone


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with their month as text, by which readers prune."""
    return spark.read.option("basePath", path).parquet(path).withColumn("month", F.col("month").cast("string"))


def _cell(v: Any) -> Any:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return int(v)
    return json.dumps(v, default=str) if isinstance(v, dict | list) else v


def to_csv(rows: Iterable[dict[str, Any]]) -> str:
    """Rows of a panel as CSV text: header of the first row's keys; nothing for no rows; nested values as JSON."""
    held = list(rows)
    if not held:
        return ""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(held[0].keys())
    for r in held:
        writer.writerow([_cell(r.get(k)) for k in held[0]])
    return out.getvalue()


def write_csv(df: DataFrame, path: str) -> None:
    """A result of any size as CSV files."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def checksum(df: DataFrame) -> dict[str, Any]:
    """Row count and an order-free checksum of a table."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": r["n"], "hash": str(r["h"])}


def backup(events: DataFrame, path: str) -> dict[str, Any]:
    """Writes the events and a manifest counted from what was written."""
    spark = events.sparkSession
    events.write.mode("overwrite").parquet(f"{path}/events")
    manifest = checksum(spark.read.parquet(f"{path}/events")) | {"at": dt.datetime.now(dt.UTC).isoformat()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def restore(spark: SparkSession, path: str, to: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The events of a backup, checked against its manifest first, and every rollup built anew.

    to: a folder into which both are written (events by month, each rollup beside them); what was written is counted
    again before it is returned.
    """
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    events = spark.read.parquet(f"{path}/events")

    def agree(found: dict[str, Any]) -> None:
        if any(found[k] != manifest[k] for k in found):
            raise ValueError(f"backup does not match its manifest: {found} against {manifest}")

    agree(checksum(events))
    if to is None:
        return events, {name: rollups.build(events, name) for name in rollups.KEYS}
    write_events(events, f"{to}/events", "overwrite")
    written = read_events(spark, f"{to}/events")
    agree(checksum(written.select(*events.columns)))
    for name in rollups.KEYS:
        rollups.build(written, name).write.mode("overwrite").parquet(f"{to}/{name}")
    return written, {name: spark.read.parquet(f"{to}/{name}") for name in rollups.KEYS}


class Retry(Exception):
    """What `send` raises where another try may help: a full or failing server. after: seconds it asked to wait."""

    def __init__(self, after: float | None = None):
        super().__init__(after)
        self.after = after


def deliver(chunk: list[dict[str, Any]], send: Callable[[list[dict[str, Any]]], int], tries: int = 4, wait: Callable[[float], None] = time.sleep) -> int:
    """How many rows of a chunk were taken. Retries after 250 ms, 500 ms and so on, 5 s at most, or as long as the server asked."""
    pause = 0.25
    for k in range(tries):
        try:
            return send(chunk)
        except (Retry, OSError) as e:
            if k == tries - 1:
                raise
            asked = e.after if isinstance(e, Retry) else None
            wait(min(pause, 5.0) if asked is None else asked)
            pause *= 2
    return 0


def push(rows: DataFrame, send: Callable[[list[dict[str, Any]]], int], chunk: int = CHUNK, tries: int = 4) -> dict[str, Any]:
    """Sends rows in chunks from the executors: send gets a chunk and returns how many rows it took.

    {delivered, failed, error}: a chunk that fails for good stops its partition, whose rows left count as failed; the
    rows of other partitions are sent, and only the counts reach the driver. A task that is run again sends again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        delivered = failed = 0
        error = None
        for pdf in batches:
            held = pdf.to_dict("records")
            for i in range(0, len(held), chunk):
                if error is None:
                    try:
                        delivered += deliver(held[i : i + chunk], send, tries)
                        continue
                    except Exception as e:  # told to the caller with what was delivered
                        error = f"{type(e).__name__}: {e}"
                failed += len(held[i : i + chunk])
        yield pd.DataFrame({"delivered": [delivered], "failed": [failed], "error": [error]})

    got = rows.mapInPandas(run, "delivered long, failed long, error string").agg(F.sum("delivered"), F.sum("failed"), F.max("error")).first()
    return {"delivered": got[0] or 0, "failed": got[1] or 0, "error": got[2]}


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """(first, last, asn, country, as_org) of a range dump: tab-separated start, end, number, country, organisation; plain
    or gzip. Rows whose ends are no two addresses of one family, or whose number is none of 32 bits, are passed over."""
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
    rows = spark.read.text(path).select(
        ip_key(cell(0), mapped=False).alias("first"), ip_key(cell(1), mapped=False).alias("last"),
        F.when(cell(2).rlike(r"\A[0-9]{1,19}\z"), cell(2).try_cast("bigint")).alias("asn"), cell(3).alias("country"), cell(4).alias("as_org"),
    )
    return rows.filter((F.char_length("first") == F.char_length("last")) & F.col("asn").between(0, 2**32 - 1))


def cidrs_in(document: Any) -> list[str]:
    """Every text in a vendor's JSON document that looks like a block or an address, at any depth."""
    out: list[str] = []
    stack = [document]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack.extend(x.values())
        elif isinstance(x, list):
            stack.extend(x)
        elif isinstance(x, str) and (":" in x or x.count(".") == 3) and set(x.lower()) <= set("0123456789abcdef.:/"):
            out.append(x)
    return sorted(set(out))
