"""The ledger keeps own columns whose names its helpers use."""

from hitscope.llm import quality


def test_own_columns_with_helpers_names(spark):
    names = ["_w", "_S", "_lines", "_at", "_low", "_bits"]
    df = spark.createDataFrame([(1, "a b c a b c", *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = quality.ledger(df).first().asDict()
    assert {c: got[c] for c in names} == {c: c for c in names} and got["n_repeat_words"] == 6
    again = quality.measure(df.drop("text").withColumnRenamed("_w", "text").withColumnRenamed("_at", "_w"), "_w").first().asDict()
    assert again["_w"] == "_at" and again["n_words"] == 1
