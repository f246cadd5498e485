"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

A text is lower-cased; every character that is no letter is a boundary. Subwords are the runs of 2 to 4 characters
whose inner characters are letters (so they may take in a word's start or end), hashed into BUCKETS rows of an
embedding. The mean embedding of all subwords of the whole text goes through a linear layer and a softmax. The
temperature and the rejection threshold come from held-back rows of the training sample.

The model is fitted on the driver from the subword counts of at most `sample` labelled rows, those of the smallest
hashes (SAMPLE rows of at most BUCKETS counts each bound what the driver holds); everything else sees all rows. Defined cases: a null text, or one without a letter, gets `und` with score 0; no labelled rows
at all: every text is `und`; repeated rows are predicted alike; extra columns are kept, but outputs replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitscope.llm.common import documents, give_back, giving_back, unused

BUCKETS, DIMS = 1 << 14, 16
SAMPLE, EPOCHS, BATCH, RATE = 3000, 6, 32, 2.0
#: At most this share of right predictions on held-back rows may be rejected, and none above a probability of one half.
REJECTED_SHARE = 0.001
UNKNOWN = "und"
CHUNK_CHARS = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = True
    return out


def _starting(piece: str, starts: int) -> np.ndarray:
    """Bucket of each subword that starts in the first `starts` characters of a piece of a lower-cased, padded text."""
    code = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
    c = np.where(_letters()[code], code, 0).astype(np.uint64)
    mixed = c * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    some = c > 0
    out = []
    h = mixed
    for n in (2, 3, 4):
        h = (h[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ (mixed[n - 1 :])
        h = h ^ (h >> np.uint64(29))
        ok = some[1 : len(some) - 1] if n == 3 else (some[:-1] | some[1:]) if n == 2 else (some[1:-2] & some[2:-1])
        out.append(((h[:starts][ok[:starts]] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64))
    return np.concatenate(out)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of the subwords of a whole text, each once, in runs of bounded size."""
    padded = " " + text.lower() + " "
    for i in range(0, len(padded), CHUNK_CHARS):
        yield _starting(padded[i : i + CHUNK_CHARS + 3], CHUNK_CHARS)


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text has, and the share of its subwords in each."""
    n = np.zeros(BUCKETS, np.int64)
    for b in subwords(text):
        n += np.bincount(b, minlength=BUCKETS)
    u = np.flatnonzero(n)
    return u, (n[u] / max(1, n.sum())).astype(np.float32)


@dataclass
class Model:
    labels: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def table(self) -> np.ndarray:
        """What each bucket adds to the scores; the mean of these is the mean embedding's score."""
        return (self.embedding @ self.weights).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        table = self.table() / self.temperature
        out = []
        for t in texts:
            total, n = np.zeros(len(self.labels)), 0
            if t and self.labels:
                for b in subwords(t):
                    total += table[b].sum(0, dtype=np.float64)
                    n += len(b)
            if not n:
                out.append((UNKNOWN, 0.0, True))
                continue
            z = total / n + self.bias / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            k = int(p.argmax())
            out.append((self.labels[k], float(p[k]), bool(p[k] < self.threshold)))
        return out


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (b, w) in enumerate(rows):
        x[i, b] = w
    return x


def fit(profiles: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    rows = [p for p in profiles if len(p[0])]
    y = [labels.index(lang) for p, lang in zip(profiles, langs, strict=True) if len(p[0])]
    if not rows:
        return Model([], np.zeros((BUCKETS, DIMS), np.float32), np.zeros((DIMS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5]
    learn = order[len(rows) // 5 :]
    target = np.array(y)
    e = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIMS, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    eye = np.eye(len(labels), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(learn), BATCH):
            at = learn[i : i + BATCH]
            x = _dense([rows[j] for j in at])
            h = x @ e
            z = h @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - eye[target[at]]) / len(at)
            gh = g @ w.T
            w -= rate * (h.T @ g)
            bias -= rate * g.sum(0)
            e -= rate * 50 * (x.T @ gh)
        learn = rng.permutation(learn)
    # temperature: the one of a grid under which held-back rows are likeliest; threshold: see REJECTED_SHARE
    cal = held if len(held) else order
    z = np.concatenate([_dense([rows[j] for j in cal[i : i + 256]]) @ e @ w + bias for i in range(0, len(cal), 256)]).astype(np.float64)

    def soft(t: float) -> np.ndarray:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    best = min(np.geomspace(0.05, 5, 41), key=lambda t: -np.log(soft(t)[np.arange(len(cal)), target[cal]] + 1e-12).mean())
    p = soft(best)
    right = np.sort(p.max(1)[p.argmax(1) == target[cal]])
    threshold = min(0.5, float(right[int(REJECTED_SHARE * len(right))])) if len(right) else 0.0
    return Model(labels, e, w, bias, float(best), threshold)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on at most `sample` rows with text and lang that are not held out."""
    open_rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.xxhash64("doc_id", "text", "lang")
    first = open_rows.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if first is None:
        return fit([], [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [profile(t) for t in pdf["text"]]
            yield pd.DataFrame({"k": pdf["k"], "lang": pdf["lang"], "u": [u.astype("<u2").tobytes() for u, _ in found], "w": [w.astype("<f4").tobytes() for _, w in found]})

    taken = open_rows.filter(place <= F.lit(first)).select(place.alias("k"), "lang", "text")
    rows = sorted(taken.mapInPandas(giving_back(run), "k long, lang string, u binary, w binary").limit(sample).collect(), key=lambda r: (r["k"], r["lang"]))
    return fit([(np.frombuffer(r["u"], "<u2").astype(np.int64), np.frombuffer(r["w"], "<f4")) for r in rows], [r["lang"] for r in rows])


def judged(text: Column, model: Model, spark: SparkSession) -> Column:
    """struct<lang_pred, score, rejected> of a text. Only the text goes through Python."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame(sent.value.predict(t.tolist()), columns=["lang_pred", "score", "rejected"])
        give_back()

    return run(text)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and rejected."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    taken = unused("_judged", docs.columns)
    found = docs.select(*[F.col(f"`{c}`") for c in own], judged(F.col("text"), model, docs.sparkSession).alias(taken))
    return found.select(*[F.col(f"`{c}`") for c in own], f"{taken}.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def language_filter(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with enough confidence, with their own columns."""
    taken = unused("_judged", docs.columns)
    found = docs.withColumn(taken, judged(F.col("text"), train(docs), docs.sparkSession))
    return found.filter(~F.col(taken)["rejected"]).drop(taken)
