"""Substring dedup by prefix-partitioned suffix trees.

A window is WINDOW consecutive words of one document; a window whose word sequence also starts elsewhere is a
repeat, and every word it covers is removed. The trees are sparse: each window is represented by one suffix
start, its anchor, the place inside it whose PREFIX words hash least. Equal windows have equal anchors at equal
places, so nothing is lost.

1. Prefixes: the PREFIX words at each anchor are counted over the whole corpus. A prefix that occurs once roots
   a subtree with one leaf, without repeats; the others' hashes set bits of a filter of fixed size (where it is
   full, more suffixes are looked at; results stay the same). Prefixes with LARGE or more suffixes are marked in
   a second filter.
2. Suffixes: those under a repeated prefix are sent, with the words around the anchor, to the partition of their
   prefix. A large prefix is lengthened to the whole window, which parts its suffixes by content; those equal
   even so are counted where they are read, and one row for each task and window is sent.
3. Subtrees: a partition sorts its suffixes; common prefix lengths of neighbours give the tree's internal nodes.
   A node at depth WINDOW - d whose leaves share the d words before the anchor, with two leaves or more, is a
   repeat. Partitions are read in batches of whole prefixes, so memory is bounded.
4. The repeats' places go back to their documents, which drop the words covered.

Words are held as hashes (64 bits for windows, 32 bits each for the words of a sent suffix).

Defined cases: a null or blank text has no words and stays (as an empty text); fewer words than a window are
kept; repeated rows repeat each other's windows; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitscope.llm.common import beside, documents, giving_back, materialize, unused

WINDOW, PREFIX, LARGE = 35, 8, 1000
PLACES = WINDOW - PREFIX + 1  # of an anchor within its window
LEFT = PLACES - 1  # words before an anchor that its windows reach
FILTER_LOG2, BLOCK_LOG2 = 26, 16
CHUNK_BYTES, SORTED_ROWS = 1_500_000, 100_000
ROOM_LOG2 = 22

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, CHUNK_BYTES + 4096), U(base))
        out[0] = U(1)
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, and the first word's number of each text (and the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space)
    starts = np.concatenate(([0], edge[:-1] + 1))
    full = edge > starts
    starts, ends = starts[full], edge[full]
    n = len(data) + 1
    total = np.zeros(n, U)
    np.cumsum((data.astype(U) + U(1)) * _power(_BASE, n)[: n - 1], out=total[1:])
    h = _mix((total[ends] - total[starts]) * _power(_INVERSE, n)[starts] + (ends - starts).astype(U) * U(0x94D049BB133111EB))
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return h, np.searchsorted(starts, at)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    if n == 1:
        return h
    half = n // 2
    a = _runs(h, half)
    pair = a[: len(h) - n + 1] * U(0xC2B2AE3D27D4EB4F + 2 * half) + a[half : half + len(h) - n + 1] * U(0x165667B19E3779F9)
    pair = pair ^ (pair >> U(31))
    if n % 2:
        pair = pair * U(0x27D4EB2F165667C5) + h[n - 1 :] * U(0x9FB21C651E98DF25)
        pair = pair ^ (pair >> U(30))
    return pair


class Windows:
    """The windows of some texts: start of each, its anchor, and hashes of prefixes."""

    def __init__(self, texts: list[bytes]):
        self.h, self.first = hashed_words(texts)
        n = len(self.h)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.start = self.anchor = np.zeros(0, np.int64)
        self.prefix = np.zeros(0, U)
        if n < WINDOW:
            return
        self.prefix = _mix(_runs(self.h, PREFIX))
        room = max(ROOM_LOG2, n.bit_length())
        least = (self.prefix >> U(room) << U(room)) | np.arange(len(self.prefix), dtype=U)
        width = 1
        while 2 * width <= PLACES:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < PLACES:
            least = np.minimum(least[: len(least) - (PLACES - width)], least[PLACES - width :])
        start = np.arange(n - WINDOW + 1)
        start = start[self.doc[start] == self.doc[start + WINDOW - 1]]
        self.start = start
        self.anchor = (least[start] & U((1 << room) - 1)).astype(np.int64)

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, and the first and last window start of each (its windows follow each other)."""
        if not len(self.start):
            return self.start, self.start, self.start
        new = np.concatenate(([True], self.anchor[1:] != self.anchor[:-1]))
        at = np.flatnonzero(new)
        last = np.concatenate((at[1:], [len(self.anchor)])) - 1
        return self.anchor[at], self.start[at], self.start[last]


def _chunks(pdf: pd.DataFrame) -> Iterator[tuple[int, list[bytes]]]:
    held: list[bytes] = []
    at = size = 0
    for i, t in enumerate(pdf["text"]):
        raw = (t or "").encode()
        held.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield at, held
            held, at, size = [], i + 1, 0
    if held:
        yield at, held


@giving_back
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for _, texts in _chunks(pdf):
            w = Windows(texts)
            anchor, _, _ = w.groups()
            key, n = np.unique(w.prefix[anchor], return_counts=True)
            yield pd.DataFrame({"key": key.view(np.int64), "n": n.astype(np.int64)})


def _bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter that a hash sets."""
    m = U((1 << FILTER_LOG2) - 1)
    return (key & m).astype(np.int64), ((key >> U(32)) & m).astype(np.int64)


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A filter with the bits of all keys: 2 ** FILTER_LOG2 bits whatever the number of keys."""

    @giving_back
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bit = np.unique(np.concatenate(_bits(pdf["key"].to_numpy(np.int64).view(U))))
            yield pd.DataFrame({"block": bit >> BLOCK_LOG2, "bit": bit & ((1 << BLOCK_LOG2) - 1)})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << BLOCK_LOG2, np.uint8)
        on[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    out = np.zeros((1 << FILTER_LOG2) // 8, np.uint8)
    blocks = keys.mapInPandas(spread, "block long, bit int").distinct().groupBy("block").applyInPandas(block, "block long, bits binary")
    size = (1 << BLOCK_LOG2) // 8
    for r in blocks.toLocalIterator():
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    a, b = _bits(key)
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)


_SENT = ["key", "doc_id", "th", "pos", "lo", "hi", "words", "done"]
SENT = "key long, doc_id long, th long, pos int, lo int, hi int, words binary, done boolean"


def _suffixes(repeated, large):
    """Rows of three kinds. A suffix: its prefix's hash, document, anchor, the range of its windows' distances to it,
    the words around it. A window under a large prefix: its hash and place; place -1 if this task has several, whose
    places are then known repeats and sent as done."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0
        for pdf in batches:
            ids, th = pdf["doc_id"].fillna(-1).to_numpy(np.int64), pdf["th"].to_numpy(np.int64)
            for at, texts in _chunks(pdf):
                w = Windows(texts)
                anchor, first, last = w.groups()
                key = w.prefix[anchor]
                hit = _has(repeated.value, key)
                anchor, first, last, key = anchor[hit], first[hit], last[hit], key[hit]
                if not len(anchor):
                    continue
                big = _has(large.value, key)
                a, f, t = anchor[~big], first[~big], last[~big]
                if len(a):
                    doc = w.doc[a]
                    padded = np.concatenate((np.zeros(LEFT, np.uint32), w.h.astype(np.uint32), np.zeros(WINDOW, np.uint32)))
                    near = padded[a[:, None] + np.arange(LEFT + WINDOW)[None, :]]
                    yield pd.DataFrame({
                        "key": key[~big].view(np.int64), "doc_id": ids[at + doc], "th": th[at + doc], "pos": (a - w.first[doc]).astype(np.int32),
                        "lo": (a - t).astype(np.int32), "hi": (a - f).astype(np.int32), "words": [x.tobytes() for x in near], "done": False,
                    })[_SENT]
                if big.any():
                    size = (last - first + 1)[big]
                    s = np.repeat(first[big], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    doc = w.doc[s]
                    held.append((_runs(w.h, WINDOW)[s], ids[at + doc], th[at + doc], s - w.first[doc]))
                    n_held += len(s)
                    if n_held >= 2_000_000:
                        yield from _resolved(held)
                        held, n_held = [], 0
        if held:
            yield from _resolved(held)

    return giving_back(run)


def _resolved(held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
    h, ids, th, s = (np.concatenate(x) for x in zip(*held, strict=True))
    key, at, n = np.unique(h, return_inverse=True, return_counts=True)
    several = n[at] > 1
    frame = lambda m, key, pos, done: pd.DataFrame({"key": key, "doc_id": ids[m], "th": th[m], "pos": pos, "lo": np.int32(0), "hi": np.int32(-1), "words": None, "done": done})[_SENT]
    single = ~several
    yield frame(single, h[single].view(np.int64), s[single].astype(np.int32), False)
    # places known already; spread by document
    yield frame(several, _mix((th[several] ^ s[several]).view(U)).view(np.int64), s[several].astype(np.int32), True)
    witness = key[n > 1]
    if len(witness):
        yield pd.DataFrame({"key": witness.view(np.int64), "doc_id": np.int64(-1), "th": np.int64(0), "pos": np.int32(-1), "lo": np.int32(0), "hi": np.int32(-1), "words": None, "done": False})[_SENT]


FOUND = "doc_id long, th long, pos int, mask long"


def _tree(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeats among the suffixes of whole prefixes: bit d of mask says that the window d words before pos repeats."""
    out = []
    done = pdf[pdf["done"]]
    if len(done):
        out.append(done[["doc_id", "th", "pos"]].assign(mask=1))
    whole = pdf[~pdf["done"] & pdf["words"].isna()]
    if len(whole):
        _, at, n = np.unique(whole["key"].to_numpy(), return_inverse=True, return_counts=True)
        again = np.bincount(at, (whole["pos"] < 0).to_numpy(np.int64)) + n >= 2
        out.append(whole[again[at] & (whole["pos"] >= 0).to_numpy()][["doc_id", "th", "pos"]].assign(mask=1))
    leaf = pdf[~pdf["done"] & pdf["words"].notna()]
    if len(leaf):
        words = np.frombuffer(b"".join(leaf["words"]), np.uint32).reshape(len(leaf), LEFT + WINDOW)
        key = leaf["key"].to_numpy(np.int64)
        lo, hi = leaf["lo"].to_numpy(), leaf["hi"].to_numpy()
        right = words[:, LEFT:]
        # suffix array: by prefix, then by the words from the anchor on
        order = np.lexsort([*(right[:, j] for j in range(WINDOW - 1, -1, -1)), key])
        right, key, lo, hi = right[order], key[order], lo[order], hi[order]
        left = words[order, :LEFT][:, ::-1]
        same = np.concatenate(([False], key[1:] == key[:-1]))
        equal = np.zeros(right.shape, bool)
        equal[1:] = right[1:] == right[:-1]
        equal[~same] = False
        common = np.where(equal.all(1), WINDOW, equal.argmin(1))
        mask = np.zeros(len(order), np.int64)
        before = np.zeros(len(order), U)
        for d in range(PLACES):
            if d:
                before = _mix(before * U(_BASE) + left[:, d - 1].astype(U) + U(1))
            node = np.cumsum(common < WINDOW - d).astype(U)
            on = np.flatnonzero((lo <= d) & (d <= hi))
            if len(on):
                _, at, n = np.unique(_mix(before[on] + _mix(node[on])), return_inverse=True, return_counts=True)
                mask[on[n[at] > 1]] |= 1 << d
        hit = mask != 0
        rows = leaf.iloc[order[hit]]
        out.append(rows[["doc_id", "th", "pos"]].assign(mask=mask[hit]))
    if not out:
        return pd.DataFrame({"doc_id": [], "th": [], "pos": [], "mask": []})
    return pd.concat(out)


@giving_back
def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= SORTED_ROWS:
            some = pd.concat(held)
            last = some["key"].iloc[-1]
            whole = some["key"] != last
            if whole.any():
                yield _tree(some[whole])
            held = [some[~whole]]
            n = len(held[0])
    if held:
        yield _tree(pd.concat(held))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id long, text, th) to the repeated windows: (doc_id, th, pos, mask), see _tree; a null doc_id is -1 there."""
    sc = docs.sparkSession.sparkContext
    counts = materialize(docs.select("text").mapInPandas(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"), "prefixes")
    repeated = sc.broadcast(_filter_of(counts.select("key")))
    large = sc.broadcast(_filter_of(counts.filter(F.col("n") >= LARGE).select("key")))
    sent = docs.select("doc_id", "text", "th").mapInPandas(_suffixes(repeated, large), SENT)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_trees, FOUND)


def _kept(text: str | None, marks) -> tuple[int, int, str]:
    words = (text or "").encode().split()
    n = len(words)
    if marks is None or not len(marks):
        return n, 0, b" ".join(words).decode()
    change = np.zeros(n + WINDOW + 1, np.int64)
    for m in marks:
        pos, mask = m["pos"], m["mask"]
        while mask:
            d = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            change[pos - d] += 1
            change[pos - d + WINDOW] -= 1
    out = np.cumsum(change)[:n] > 0
    kept = [w for w, gone in zip(words, out.tolist(), strict=True) if not gone]
    return n, n - len(kept), b" ".join(kept).decode()


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs with kept_text, n_words and n_removed added; own columns of these names are replaced, others stay as they are."""
    added = ("kept_text", "n_words", "n_removed")
    own = [c for c in docs.columns if c not in added]
    key, th, marks_of = (unused(c, own) for c in ("_id", "_th", "_marks"))
    keyed = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias(key), F.xxhash64("text").alias(th))
    found = materialize(repeats(keyed.select(F.col(key).alias("doc_id"), "text", F.col(th).alias("th"))), "repeats")
    marks = found.groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(F.collect_set(F.struct("pos", "mask")).alias(marks_of))
    joined = keyed.join(marks, [key, th], "left").drop(key, th)
    count = (T.LongType(), pa.int64())

    def work(texts: list[str | None], marks: list[list[dict[str, int]] | None]) -> list[list[int] | list[str]]:
        got = [_kept(t, m) for t, m in zip(texts, marks, strict=True)]
        return [[g[i] for g in got] for i in range(3)]

    return beside(joined, ["text", marks_of], [("n_words", *count), ("n_removed", *count), ("kept_text", T.StringType(), pa.string())], work, dropped=(marks_of,))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
with d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') as w from documents),
s as (select rid, unnest(range(1, len(w) - 33)) as i, w from d where len(w) >= 35),
h as (select rid, i, md5(array_to_string(w[i:i+34], ' ')) as k from s),
r as (select rid, i from (select rid, i, count(*) over (partition by k) as n from h) where n > 1),
c as (select distinct rid, i + o as p from r, range(0, 35) t(o)),
u as (select rid, unnest(w) as x, generate_subscripts(w, 1) as p from d),
j as (select u.rid, string_agg(x, ' ' order by p) as kept, count(*) as n from u anti join c on u.rid = c.rid and u.p = c.p group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(j.n, 0))::bigint as n_removed, sha256(coalesce(j.kept, '')) as kept_sha256
from d left join j using (rid)
"""
