"""The corpus pipeline: language ID, quality rules, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and all but the last give back
the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitscope.llm import bpe, langid, nearcopies, packing, quality, substrings
from hitscope.llm.common import bounded_batches, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: texts without a letter, and those under the calibrated threshold."""
    bounded_batches(spark)
    return langid.language_filter(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the current quality policy."""
    return quality.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies: five-word Jaccard of 0.8 or more, verified.

    Pairs are proposed by multi-index hashing of SimHash fingerprints over five words; an index of the shingle sets
    themselves proposes those whose fingerprints lie too far apart, so that none is missed.
    """
    bounded_batches(spark)
    return nearcopies.near_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by its kept words, joined by one space, where words are removed; other texts stay as they are.

    Columns besides doc_id and text go through under names that nothing else uses.
    """
    bounded_batches(spark)
    names = {c: c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)}
    found = substrings.substring_dedup(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    out = {c: F.col(n) for c, n in names.items()} | {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return found.select(*[column.alias(c) for c, column in out.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining texts into sequences of 1024 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, bpe.tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeats),
    ("packing", packed),
]

#: The trained language model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/hitscope/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
