"""Ids beyond 2^53 beside nulls, and own columns of every kind, go through each operator unchanged."""

import datetime

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hitscope.llm import bpe, nearcopies, orderminhash, packing, pages, privacy, quality, sharding, simhash, substrings

BIG = 2**53
IDS = [BIG + 1, BIG + 3, None, BIG + 5]
LATE = datetime.datetime(9999, 1, 1, 1, 2, 3, 456789)
OWN = "n long, late timestamp_ntz, parts array<struct<x:long>>, _body string"
PROSE = " ".join(f"alpha{i % 7} beta{i % 11} gamma{i % 5}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [PROSE, PROSE + " more", "short", None]
    rows = [(i, t, BIG + 1 if k == 1 else None, LATE if k == 1 else None, [(BIG + 3,)] if k == 1 else None, "own") for k, (i, t) in enumerate(zip(IDS, texts, strict=True))]
    return spark.createDataFrame(rows, f"doc_id long, text string, {OWN}").coalesce(1)


def check(got):
    rows = {r["doc_id"]: r for r in got.select("doc_id", "n", "late", "parts", "_body").collect()}
    assert set(rows) <= set(IDS) and BIG + 3 in rows
    r = rows[BIG + 3]
    assert (r["n"], r["late"], r["parts"][0]["x"], r["_body"]) == (BIG + 1, LATE, BIG + 3, "own")


FILE = lambda: bpe.tokenizer_file("byte_bpe_50k.tiktoken")
KEEP = {
    "encode": lambda d: bpe.encode(d, FILE(), bpe.default_pattern()),
    "decode": lambda d: bpe.decode(bpe.encode(d, FILE(), bpe.default_pattern()), FILE(), bpe.default_pattern()),
    "pages": lambda d: pages.extract_text(d.withColumn("html", F.col("text"))),
    "substrings": substrings.substring_dedup,
    "repeats stage": lambda d: corpus_pipeline.repeats(d.sparkSession, d, ""),
    "ledger": quality.measure,
    "privacy": privacy.sanitised,
}


@pytest.mark.parametrize("name", list(KEEP))
def test_own_columns_stay(docs, name):
    check(KEEP[name](docs))


def test_near_dedup_stage(docs):
    kept = nearcopies.near_dedup(docs.filter("text is null or text != 'short'"))
    assert {r["doc_id"] for r in kept.collect()} == {BIG + 1, BIG + 5}
    check(nearcopies.near_dedup(docs.filter(F.col("doc_id") == BIG + 3)))


def test_ids(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for query in (bpe.op1, sharding.op2, orderminhash.op3, packing.op5, substrings.op7, quality.op9, simhash.op10, privacy.op12):
        assert {r["doc_id"] for r in query(spark, str(tmp_path)).select("doc_id").collect()} == set(IDS), query.__name__


def test_pages_ids(spark, tmp_path):
    rows = [(i, "u", "<p>some text of a page</p>") for i in IDS]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"] for r in pages.op4(spark, str(tmp_path)).collect()} == set(IDS)
