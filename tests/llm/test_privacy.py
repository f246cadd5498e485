"""Personal data: spans against Python's regular expressions as the contract writes them, disclosures against plain counting."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from hitscope.llm import privacy

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def odd_texts():
    r = random.Random(5)
    pieces = ["ab", "a.b", "@", "x@y.z", "é@ü.de", ".", "-", " ", "\n", "+", "1", "12", "255", "256", "1.2.3.4", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1111", "0" * 16, "+1 (017) 555-7713", "()", "%", "日本", "😀", "_", "a@b.c%d@e.f", "+1", "5"]
    out = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(900)]
    return [*out, None, "", " ", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "+1((((((((2 34567890", "a@-.b", "@a.b", "x@y", "x@y..z", "999.1.1.1 1.1.1.1"]


def test_base_spans(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    of_kind = lambda k: F.transform(privacy.identifiers(F.coalesce("text", F.lit("")), k), lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    base = F.concat(*map(of_kind, privacy.PATTERNS))
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", base.alias("s")).collect()}
    assert got == {i: [f"{k}:{a}:{b}" for k, a, b in plain_spans(t)] for i, t in enumerate(texts)}


def test_long_texts(spark):
    """Texts on which a plain search takes time in the square of their length."""
    texts = ["a" * 300_000, "a@" + "b." * 200_000, "1" * 300_000, "1 " * 150_000, "+1" + "(" * 300_000, "a." * 100_000 + "@", "a@b.cc 1.2.3.4 x " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in privacy.sanitised(df, spark.createDataFrame([], "term string, disclosure double")).collect()}
    none = {0, 2, 3, 4, 5}
    assert {i for i, r in got.items() if not r["spans"]} == none and all(got[i]["clean_text"] == texts[i] for i in none)
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(0, 400_001)]
    assert [(s["kind"], s["start"], s["end"]) for s in got[6]["spans"]] == [("email", 17 * i, 17 * i + 6) for i in range(20_000)] + [("ip", 17 * i + 7, 17 * i + 14) for i in range(20_000)]
    assert got[6]["clean_text"] == "[email] [ip] x " * 20_000


def corpus():
    """Documents in which one term stands beside an address in many contexts, and copies of one that proves nothing."""
    r = random.Random(8)
    words = [a + b + c for a in ("tal", "mor", "ke") for b in ("in", "ar", "us") for c in ("da", "lo", "ne", "")]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    texts = [prose(30) for _ in range(120)]
    texts += [f"{prose(9)} Quibble {prose(r.randrange(3))} q@ex-{1}.org {prose(8)}" for _ in range(9)]
    texts += [f"{prose(5)} Quibble {prose(4)}"]
    texts += [f"{prose(4)} 77421 {prose(1)} +44 1632 960123 {prose(7)}" for _ in range(6)]
    texts += ["Unique rare vocable beside q2@ex.org and nothing more"] * 8 + [None, ""]
    return texts


def plain_disclosures(texts):
    term = re.compile(r"[^\W_]{3,}")
    anything = re.compile("|".join(f"(?:{p})" for p in (PLAIN["email"], PLAIN["ip"], PLAIN["phone"], r"[0-9]([\x20-]?[0-9]){12,}")))
    n_entity, n_term, n_both, windows = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t in texts:
        t = t or ""
        found = list(anything.finditer(t))
        cuts = [0, *[x for m in found for x in m.span()], len(t)]
        between = [term.findall(t[cuts[i] : cuts[i + 1]]) for i in range(0, len(cuts), 2)]
        n_term.update({w for b in between for w in b})
        entities, both = set(), set()
        for i, m in enumerate(found):
            m = m.group()
            kind = "email" if "@" in m else "phone" if m[0] == "+" else "ip" if "." in m else "card"
            if not valid(kind, m):
                continue
            e = (kind, m.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", m))
            left, right = between[i][-6:], between[i + 1][:6]
            entities.add(e)
            for w in {*left, *right}:
                both.add((e, w))
                windows[e, w].add((tuple(left), tuple(right)))
        n_entity.update(entities)
        n_both.update(both)
    out = {}
    for (e, w), seen in windows.items():
        if len(seen) >= 3:
            content = math.log2(len(texts) / n_entity[e])
            out[":".join(e), w] = (len(seen), n_both[e, w], n_entity[e], n_term[w], round(math.log2(n_both[e, w] * len(texts) / n_entity[e] / n_term[w]) / content, 6) if content > 0 else 0.0)
    return out


def test_disclosures(spark):
    texts = corpus()
    df = spark.createDataFrame([(t or "",) for t in texts], "text string").repartition(5)
    got = {(r["entity"], r["term"]): (r["windows"], r["n_both"], r["n_entity"], r["n_term"], round(r["disclosure"], 6)) for r in privacy.disclosures(df).collect()}
    assert got == plain_disclosures(texts)
    assert {w for (_, w), v in got.items() if v[-1] >= privacy.GENERALISED} == {"Quibble", "77421"}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_terms_are_taken_out(spark, monkeypatch, limit):
    monkeypatch.setattr(privacy, "BROADCAST_TERMS", limit)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "own", "x") for i, t in enumerate(texts)], "doc_id int, text string, _body string, _marks string")
    rows = {r["doc_id"]: r for r in privacy.sanitised(df).collect()}
    assert rows[0].asDict().keys() == {"doc_id", "text", "_body", "_marks", "spans", "clean_text"} and rows[0]["_body"] == "own"
    for i, t in enumerate(texts):
        t = t or ""
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"(?<![^\W_])(?:Quibble|77421)(?![^\W_])", t)]
        expected = plain_spans(t) + terms
        assert [(s["kind"], s["start"], s["end"]) for s in rows[i]["spans"]] == expected
        clean = t
        for kind, a, b in sorted(expected, key=lambda s: -s[1]):
            clean = clean[:a] + {"term": "[name]" if t[a:b] == "Quibble" else "", "email": "[email]", "phone": "[phone]"}[kind] + clean[b:]
        assert rows[i]["clean_text"] == clean


def test_replacement_of_overlapping_spans(spark):
    text = "x" * 3000 + " 4111 1111 1111 1111@mail.org " + "y" * 5000 + " 1.2.3.4"
    got = privacy.sanitised(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [s["kind"] for s in got["spans"]] == ["email", "ip", "card"]
    assert got["clean_text"] == "x" * 3000 + " [card] " + "y" * 5000 + " [ip]"


def test_empty_table(spark):
    assert privacy.sanitised(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame([(2**53 + i, t) for i, t in enumerate(texts)] + [(None, "q@ex-1.org")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in privacy.op12(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t)
        r = got[2**53 + i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in base) for k in PLAIN]
    assert got[None]["n_email"] == 1
