"""Spelling variants: words that are one edit apart, found by a positional q-gram inverted index with a count filter.

The index is cut into blocks that fit a task. For a pair whose longer word has M code points, let the edit be at the
pair's first difference. A block of M names a window of places; it holds the words of M and of M - 1 code points that
are equal before the window and equal after it, so a pair meets in just one of the blocks whose windows share out the
places: that with its first difference. Blocks of more than BLOCK words are cut once more, by halving their windows,
until a window is one place wide; such a block holds no more words than the alphabet has letters, and one. So no block
grows with the corpus, and no pair is lost.

In a block, each q-gram that touches the window has a posting list of the words that hold it, with its place and the
word's length, in order of the words. The lists of a word's grams are merged in order (all words of a batch at once, by
one sort), under the length limit (one at most of the two is shorter) and the position limit (places at most one apart).
Grams outside the window are in all words of the block, in lists that need no merging: they only add to the count. Pairs
with at least M - 2q + 1 common grams, which one edit must leave, are verified.

A word's form is its near word of largest count, if that is at least RATIO times its own; its root is the last form that
following forms leads to, found by pointer doubling (counts grow RATIO-fold at each step, so there are no circles).

Defined cases: a null text has no words, and a null doc_id counts as empty in the checksum of `damaged`; repeated rows
count as often as they stand; an empty table has no words; other columns are not read. Words of any length are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitscope.llm.common import documents, materialize

#: What a word is made of, its least length and count, and how much more frequent its form must be.
LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO = r"A-Za-zÀ-ÿ", 7, 2, 10
#: One word in so many is damaged by `damaged`.
DAMAGED = 31
Q = 2
#: Windows that a word's places are first shared out into, and words of a block that is not cut again.
WINDOWS, BLOCK = 4, 64
#: Grams whose lists are merged at once.
MERGED = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, least: int = LEAST_LENGTH) -> Column:
    """The maximal runs of letters of at least so many code points, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run without one code point, where its checksum with the document's id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % DAMAGED == 0, cut).otherwise(run)


def word_counts(occurrences: DataFrame) -> DataFrame:
    """(word) rows to (word, n) for the words that are long and frequent enough."""
    long_enough = occurrences.filter(F.char_length("word") >= LEAST_LENGTH)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _row(m: Column, lo: Column, hi: Column) -> Column:
    """A word's place in the block of m whose window is [lo, hi)."""
    tail = m - hi
    after = F.when(tail > 0, F.substring(F.col("word"), F.char_length("word") - tail + 1, tail)).otherwise("")
    return F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi"), F.xxhash64(F.substring(F.col("word"), F.lit(1), lo), F.lit(0), after).alias("h"))


def _first_windows(words: DataFrame) -> DataFrame:
    size = F.char_length("word")
    edge = lambda m, i: (m * i / WINDOWS).cast("int")
    of = lambda m: [_row(m, edge(m, i), edge(m, i + 1)) for i in range(WINDOWS)]
    return words.select("word", "n", F.explode(F.array(*of(size), *of(size + 1))).alias("b")).select("b.*", "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of blocks that are too large, in the two halves of their windows."""
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(_row(F.col("m"), F.col("lo"), middle), _row(F.col("m"), middle, F.col("hi")))
    return rows.select("word", "n", F.explode(halves).alias("b")).select("b.*", "word", "n")


def _candidates(m: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, block: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (earlier, later) of one block that pass the count filter. at: where each row's word begins in codes."""
    n = len(size)
    short = m - size
    begin = np.maximum(lo - Q + 1, 0)
    grams = np.maximum(np.minimum(hi - short, size - Q + 1) - begin, 0)
    row = np.repeat(np.arange(n), grams)
    place = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + begin[row]
    first = at[row] + place
    _, gram = np.unique((codes[first].astype(np.int64) << 21) | codes[first + 1], return_inverse=True)
    least = m - 2 * Q + 1 - np.maximum(lo - Q + 1, 0) - np.maximum(m - hi - Q + 1, 0)

    def pairs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (earlier, later) of each two equal entries of key, in the order of a stable sort."""
        order = np.argsort(key, kind="stable")
        held = key[order]
        start = np.concatenate(([True], held[1:] != held[:-1])) if len(held) else np.zeros(0, bool)
        begins = np.maximum.accumulate(np.where(start, np.arange(len(held)), 0)) if len(held) else np.zeros(0, np.int64)
        before = np.arange(len(held)) - begins
        later = np.repeat(np.arange(len(held)), before)
        earlier = np.arange(len(later)) - np.repeat(np.cumsum(before) - before, before) + begins[later]
        return order[earlier], order[later]

    x, y = pairs(block[row] * (gram.max(initial=0) + 1) + gram)
    near = (np.abs(place[x] - place[y]) <= 1) & (short[row[x]] + short[row[y]] <= 1) & (row[x] != row[y])
    met, count = np.unique(row[x[near]] * n + row[y[near]], return_counts=True)
    a, b = met // max(n, 1), met % max(n, 1)
    enough = count >= least[a]
    # windows so narrow that an edit may leave none of their grams: all words of these small blocks are candidates
    free = np.flatnonzero(least <= 0)
    p, q = (free[i] for i in pairs(block[free]))
    met = np.union1d(a[enough] * n + b[enough], (p * n + q)[short[p] + short[q] <= 1])
    return met // max(n, 1), met % max(n, 1)


def first_difference(x: str, y: str, lo: int, hi: int) -> bool:
    """Whether x, as long as y or one shorter, is one edit from y with the first difference in [lo, hi) of y."""
    if x[:lo] != y[:lo]:
        return False
    i, end = lo, min(hi, len(x))
    while i < end and x[i] == y[i]:
        i += 1
    return i < hi and i < len(y) and y[i + 1 :] == (x[i + 1 :] if len(x) == len(y) else x[i:])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to what they tell of their words: near words, and the best of them by count."""
    for whole in batches:
        sizes = whole.column("words").value_lengths().to_numpy()
        # lists of a batch are merged in slices, so that memory follows the slice
        ends = np.searchsorted(np.cumsum(sizes), np.arange(MERGED // 8, int(sizes.sum()) + MERGED // 8, MERGED // 8), side="left") + 1
        last = 0
        for end in np.unique(np.minimum(ends, whole.num_rows)):
            yield _told(whole.slice(last, end - last))
            last = int(end)


def _told(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("words")
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten()
    words, n = flat.field("word").to_pylist(), flat.field("n").to_pylist()
    block = np.repeat(np.arange(len(sizes)), sizes)
    m, lo, hi = (batch.column(c).to_numpy().astype(np.int64)[block] for c in ("m", "lo", "hi"))
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    a, b = _candidates(m, lo, hi, size, block, np.cumsum(size) - size, codes)
    near: dict[int, int] = {}
    best: dict[int, int] = {}
    for i, j, low, high in zip(a.tolist(), b.tolist(), lo[a].tolist(), hi[a].tolist(), strict=True):
        x, y = words[i], words[j]
        if first_difference(x, y, low, high) if len(x) <= len(y) else first_difference(y, x, low, high):
            for u, v in ((i, j), (j, i)):
                near[u] = near.get(u, 0) + 1
                w = best.get(u)
                if w is None or (-n[v], words[v]) < (-n[w], words[w]):
                    best[u] = v
    return pa.RecordBatch.from_pydict({
        "word": pa.array([words[u] for u in near], pa.string()), "n_near": pa.array(list(near.values()), pa.int64()),
        "best_n": pa.array([n[best[u]] for u in near], pa.int64()), "best": pa.array([words[best[u]] for u in near], pa.string()),
    })


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) of distinct words to (word, n_near, best, best_n) for each word with a near word: how many there are,
    and that of largest n, the smallest of equal ones."""
    key = ["m", "lo", "hi", "h"]
    rows, told = _first_windows(words), None
    while True:
        rows = materialize(rows, "spelling-rows")
        counts = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter((F.col("c") > BLOCK) & (F.col("hi") - F.col("lo") > 1)).drop("c"), "spelling-large")
        done = rows.join(counts, key, "left_anti").groupBy(*key).agg(F.collect_list(F.struct("word", "n")).alias("words"))
        told_here = done.filter(F.size("words") > 1).select("m", "lo", "hi", "words").mapInArrow(_near, "word string, n_near long, best_n long, best string")
        told_here = materialize(told_here, "spelling-near")
        told = told_here if told is None else told.unionByName(told_here)
        if counts.isEmpty():
            break
        rows = _halved(rows.join(counts, key, "left_semi"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def _with_roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root)."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def variants(words: DataFrame) -> DataFrame:
    """(word, n) of distinct words to (word, n, n_near, form, form_n, root) for each of them."""
    words = materialize(words, "spelling-words")
    joined = words.join(near_words(words), "word", "left")
    much = F.col("best_n") >= RATIO * F.col("n")
    found = materialize(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best")).alias("form"), F.when(much, F.col("best_n")).alias("form_n")), "spelling-forms"
    )
    roots = _with_roots(found.filter(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def respelled(occurrences: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with a column word, with `root` beside it: that of `variants`, or the word itself."""
    moved = found.filter(F.col("form").isNotNull()).select("word", F.col("root").alias("_root"))
    return occurrences.join(moved, "word", "left").withColumn("root", F.coalesce("_root", "word")).drop("_root")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    occurrences = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return variants(word_counts(occurrences)).select("word", "form", "root", "n", "n_near", "form_n")
