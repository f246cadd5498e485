"""What the text operators share: word splitting, durable intermediate tables, table loading."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitscope.storage import shared_dir

#: A word is a maximal run of characters other than these.
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[ \\t-\\r]+"
#: Rows whose values a worker holds as Python objects at once.
ROWS_AT_ONCE = 500
#: Bytes of an Arrow batch that a worker gets in the pipeline (Spark's own limit is 64 MB).
BATCH_BYTES = 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, and lost executors cost only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hitscope/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on, batches of this session end at BATCH_BYTES, unless it names a limit of its own: an executor holds each
    several times, as Arrow in its JVM and again in its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Gives what this process has freed back to the system: what Arrow keeps, and the C library where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(work: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """work, over the batches of a task, and give_back() after the last: workers outlive their tasks and stages."""

    @wraps(work)
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def beside(df: DataFrame, sources: list[str], made: list[tuple[str, T.DataType, pa.DataType]], work: Callable[..., Sequence[Any]], dropped: tuple[str, ...] = ()) -> DataFrame:
    """df with columns made of others, in Arrow batches. work gets a list of values for each source and gives a sequence of
    values for each column in made. All other columns go through as they are: no key is ever a float, no time is cut short."""
    names = {n for n, _, _ in made}
    own = [f for f in df.schema.fields if f.name not in names and f.name not in dropped]
    kept = [f.name for f in own]
    sent = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"source {i}") for i, c in enumerate(sources)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                got = work(*[batch.column(len(kept) + i).to_pylist() for i in range(len(sources))])
                columns = [batch.column(i) for i in range(len(kept))] + [pa.array(x, t) for x, (_, _, t) in zip(got, made, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *[n for n, _, _ in made]])

    return sent.mapInArrow(giving_back(run), T.StructType([*own, *[T.StructField(n, t) for n, t, _ in made]]))


def unused(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column has it (Spark's names differ by more than case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """array<string> of the words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPLIT))


def numbered(df: DataFrame, key: str, unit: Column, order: list[Column], out: str) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, although one key may hold most rows.

    Rows are ordered inside (key, unit); a small table of the units' sizes gives each unit its first number.
    key and unit must be non-null, and the units must be many enough that one fits a task.
    """
    from pyspark.sql import Window as W

    of, at, n, first_of = (unused(c, df.columns) for c in ("_unit", "_at", "_n", "_first"))
    named = df.withColumn(of, unit)
    inside = W.partitionBy(key, of).orderBy(*order)
    ahead = W.partitionBy(key).orderBy(of).rowsBetween(W.unboundedPreceding, -1)
    first = (
        named.groupBy(key, of).agg(F.count(F.lit(1)).alias(n))
        .withColumn(first_of, F.coalesce(F.sum(n).over(ahead), F.lit(0)))
        .drop(n)
    )
    return (
        named.withColumn(at, F.row_number().over(inside) - 1)
        .join(first, [key, of])
        .withColumn(out, (F.col(first_of) + F.col(at)).cast("long"))
        .drop(of, at, first_of)
    )
