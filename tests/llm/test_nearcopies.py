"""Near copies of five-word Jaccard 0.8 or more, held against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from hitscope.llm import nearcopies, simhash


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_roots(texts):
    sets = list(map(five, texts))
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if (5 * len(x & y) >= 4 * len(x | y)) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if k == hi else k for k in root]
    return root


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(11)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    out = [(i, list(r.choice(vocabulary, int(r.integers(100, 200))))) for i in range(40)]
    passage = list(r.choice(vocabulary, 40))
    out += [(100 + i, passage + list(r.choice(vocabulary, 60))) for i in range(30)]
    for i in range(40):  # one run of words replaced: likeness from 0.95 down to about 0.7
        w = list(out[i][1])
        k = int(len(w) * (0.02 + 0.004 * (i % 40)))
        w[20 : 20 + k] = r.choice(vocabulary, k)
        out.append((200 + i, w))
    base = list(r.choice(vocabulary, 150))
    for i in range(60):  # a group around one text, many pairs of which are under 0.8
        w = list(base)
        at = int(r.integers(0, 130))
        w[at : at + 9] = r.choice(vocabulary, 9)
        out.append((300 + i, w))
    texts = [(i, " ".join(w)) for i, w in out]
    return texts + [(400, None), (401, " \t"), (402, "one two"), (403, "ONE two"), (404, "one three"), (405, texts[0][1])]


def expected(rows):
    least = {}
    for (i, _), root in zip(rows, brute_roots([t for _, t in rows]), strict=True):
        least[root] = min(i, least.get(root, i))
    return sorted(least.values())


def test_segments_miss_no_pair():
    r = np.random.default_rng(0)
    some = lambda k: np.unique(r.integers(0, 2**64, k, dtype=np.uint64))
    tried = 0
    for _ in range(3000):
        x = some(int(r.integers(1, 400)))
        k = len(x) // 4
        y = np.unique(np.concatenate((r.choice(x, len(x) - int(r.integers(0, k + 1)), replace=False), some(int(r.integers(0, k + 1))))))
        shared = len(np.intersect1d(x, y))
        apart = len(x) + len(y) - 2 * shared
        assert nearcopies.differing(nearcopies.parities(x), nearcopies.parities(y)) <= apart
        if 5 * shared >= 4 * (shared + apart):
            tried += 1
            assert len(np.intersect1d(nearcopies.signatures(x), nearcopies.signatures(y)))
    assert tried > 500
    assert [nearcopies.level(nearcopies.largest(k)) for k in (0, 1, 2, 5, 12)] == [0, 1, 2, 5, 12]
    assert all(nearcopies.level(nearcopies.largest(k) + 1) > k for k in range(20))


@pytest.mark.parametrize("few", [False, True])
def test_stage_keeps_one_of_each_group(spark, rows, monkeypatch, few):
    if few:  # every bound that only divides the work, made small
        monkeypatch.setattr(nearcopies, "PART_SEGMENTS", 50)
        monkeypatch.setattr(nearcopies, "BROADCAST_KEYS", 0)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, size int").repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.collect())
    assert got == expected(rows)
    assert len(got) < simhash.near_dedup(docs).count()


def test_rounds_lose_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds, easy in ((1, 4), (4, 0)):
        monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
        monkeypatch.setattr(nearcopies, "EASY", easy)
        assert sorted(r["doc_id"] for r in nearcopies.near_dedup(docs).collect()) == expected(rows)


def test_ids_null_or_repeated(spark):
    r = np.random.default_rng(3)
    a, b, c, d = (" ".join(r.choice([f"w{i}" for i in range(900)], 60)) for _ in range(4))
    docs = spark.createDataFrame([(None, a), (None, b), (None, None), (1, c), (1, c), (1, d), (0, d)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in nearcopies.near_dedup(docs).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (None, None), (1, c), (0, d)], key=str)
    assert nearcopies.near_dedup(docs.limit(0)).count() == 0


def test_simhash_survivors_with_ids_null_or_repeated(spark):
    r = np.random.default_rng(4)
    a, b, c, d = (" ".join(r.choice([f"w{i}" for i in range(900)], 60)) for _ in range(4))
    docs = spark.createDataFrame([(None, a), (None, b), (1, c), (1, d), (0, d), (0, d)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.near_dedup(docs).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (0, d)], key=str)


def test_fingerprints_propose_pairs(spark, rows):
    """All pairs at 3 or fewer bits are connected by what the fingerprints propose, and edited copies are among them."""
    r = np.random.default_rng(5)
    long = [list(r.choice([f"w{i}" for i in range(3000)], 600)) for _ in range(20)]
    edited = [w[:300] + ["new"] + w[301:] for w in long]
    texts = rows + [(1000 + i, " ".join(w)) for i, w in enumerate(long)] + [(2000 + i, " ".join(w)) for i, w in enumerate(edited)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    index = nearcopies._index(docs).select("doc_id", "h", "fp").collect()
    by_id = {x["doc_id"]: x for x in index}
    for i, t in texts:
        hashed = nearcopies.shingles(t)
        bits = sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in hashed) > len(hashed))
        assert by_id[i]["fp"] % 2**64 == bits
    pairs = {(p["a"], p["b"]) for p in nearcopies.proposed(nearcopies._index(docs)).collect()}
    assert all(a > b for a, b in pairs)
    root = {x["h"]: x["h"] for x in index}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    apart = lambda x, y: (x["fp"] ^ y["fp"]).__and__(2**64 - 1).bit_count()
    close = [(x["h"], y["h"]) for i, x in enumerate(index) for y in index[:i] if apart(x, y) <= 3]
    assert len({c for c in close if c[0] != c[1]}) >= 10
    assert all(find(x) == find(y) for x, y in close)
    found = sum((max(a, b), min(a, b)) in pairs for i in range(20) for a, b in [(by_id[1000 + i]["h"], by_id[2000 + i]["h"])])
    assert found >= 15
