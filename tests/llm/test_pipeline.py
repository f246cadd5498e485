"""The pipeline's stages on a small table with planted cases, and the registered queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import brute_repeats


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(8)
    stems = {"aa": ["tion", "the", "and", "ing", "ere"], "bb": ["eau", "que", "ment", "oux", "ai"]}
    prose = lambda k, n: " ".join("".join(r.choice(stems[k], 3)) for _ in range(n))
    rows = [(i, prose(k, int(r.integers(80, 160))), k, "s", 0) for i, k in enumerate(["aa", "bb"] * 40)]
    shared = prose("aa", 55)
    rows += [(100 + i, prose("aa", 70) + " " + shared + " " + prose("aa", 70), "aa", "s", 0) for i in range(3)]
    rows += [(200, rows[0][1], "aa", "s", 0), (201, rows[1][1], "bb", "t", 0)]
    rows += [(300, "12 34 !!", "aa", "s", 0), (301, None, "aa", "s", 0), (302, "short text", "aa", "s", 0), (303, "## $$ %% abc tion " * 40, "aa", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    now = docs
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, "")
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
        if name == "substring dedup":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            expected = dict(zip(texts, brute_repeats(list(texts.values())), strict=True))
            for r in now.collect():
                n, removed, text = expected[r["doc_id"]]
                assert r["text"] == (text if removed else texts[r["doc_id"]])
                assert removed > 0 if 100 <= r["doc_id"] < 103 else removed == 0
    whole = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert whole - kept[0] == {300, 301}
    assert kept[0] - kept[1] == {302, 303}
    assert kept[1] - kept[2] == {200, 201}
    assert kept[4] == kept[3] == kept[2]


def test_stages_leave_other_columns_alone(spark, docs):
    names = ["n_words", "n_removed", "kept_text", "_id", "_th", "_marks", "_row", "_r", "lang_pred", "rejected", "own_0", "h", "root"]
    odd = docs.select("*", *[F.concat_ws("-", F.lit(n), "doc_id").alias(n) for n in names]).withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns, name
        assert out.filter(" or ".join(f"`{n}` != concat_ws('-', '{n}', doc_id)" for n in names)).count() == 0
        assert out.filter("tags['a'] != doc_id").count() == 0 and out.count() > 0


def test_stages_take_empty_tables(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == []
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "SimHash near-dedup", "substring dedup", "packing"]
