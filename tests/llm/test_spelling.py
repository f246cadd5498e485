"""Spelling variants against plain counting and a plain search for near words."""

import collections
import random
import re
import zlib

import pytest

from hitscope.llm import spelling

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(docs):
    n = collections.Counter()
    for doc, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return y[i + 1 :] == (x[i + 1 :] if len(x) == len(y) else x[i:])


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def rows(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def dense_words(r, k):
    """Words of few letters, so that many are near each other, at all lengths from 7 on."""
    out = set()
    while len(out) < k:
        w = "".join(r.choice("abÿ") for _ in range(r.randrange(7, 10))) if r.random() < 0.5 else "prefixx" + "".join(r.choice("abcé") for _ in range(r.randrange(1, 6))) + "suffix"
        out.add(w)
    return sorted(out)


@pytest.mark.parametrize("block", [64, 3])
def test_near_words(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    r = random.Random(4)
    n = {w: int(2 * 10 ** (4 * r.random())) for w in dense_words(r, 700)} | {"x" * 400: 2, "x" * 401: 50, "x" * 200 + "y" + "x" * 200: 3, "aaaaaaa": 1000, "aaaaaaaa": 10_000_000}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert rows(spelling.variants(df)) == plain_variants(n)


def test_registered(spark, tmp_path):
    r = random.Random(6)
    vocabulary = dense_words(r, 60)
    texts = [" ".join(r.choices(vocabulary, weights=[1 + i**2 for i in range(60)], k=60)).upper() if i % 3 else "-".join(r.choices(vocabulary, k=30)) for i in range(80)]
    docs = [(2**53 + i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, None), (6, ""), (7, "ÀÉÎ日本 ßtraßenbahn ×÷×÷×÷× ßtraßenbahn ×÷×÷×÷×"), (8, texts[1]), (8, texts[1])]
    spark.createDataFrame([(d, t, "w", "n") for d, t in docs], "doc_id long, text string, word string, n string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(spelling.op11(spark, str(tmp_path)))
    assert got == plain_variants(plain_words(docs)) and "×÷×÷×÷×" in got


def test_respelled_and_empty(spark):
    found = spelling.variants(spark.createDataFrame([("necessary", 100), ("neccessary", 3)], "word string, n long"))
    df = spark.createDataFrame([("neccessary", 1), ("other", 2), ("necessary", 3)], "word string, k long")
    assert {r["k"]: r["root"] for r in spelling.respelled(df, found).collect()} == {1: "necessary", 2: "other", 3: "necessary"}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
