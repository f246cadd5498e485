"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The new words of a whole chunk of the corpus are laid out as one sequence of symbols. An inverted index of its pairs
gives the places at which each stands, and these their rank; ranks are applied from the lowest, each at all its places,
and only the two neighbours of a merged pair are indexed anew. Short words go in waves, in which all words at once
apply the lowest rank that each still has; in long ones all places of one rank are applied after the other's. Finished
words stay in a table of bounded size, so that a word is replayed once while it stays.

Defined cases: a null text is empty and has no ids; repeated rows are encoded alike; extra columns are kept, but
one named as the output is replaced; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitscope.llm.common import beside, documents

#: Bytes of each of a worker's two tables, the longest piece they keep, and characters taken together as one chunk of the corpus.
TABLE_BYTES, LONGEST_KEPT, CHUNK_CHARS = 20_000_000, 64, 1_000_000
#: About what a table entry takes besides its own characters.
ENTRY_BYTES = 200
#: Bytes of each table where little else shares the worker's memory, as in a query of its own.
QUERY_TABLE_BYTES = 100_000_000
#: Bytes of a word up to which it is replayed in waves, of which it needs fewer than it has bytes.
SHORT = 64
#: Higher than any rank: the pair is no token.
NO_RANK = 2**31 - 1

#: No match of the pre-tokenizer's pattern goes on from a character that is not white space to one that is.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
RUN = re.compile(r"\s[ \n\v]")


def _runs(text: str) -> bool:
    """Whether white space of the text must stay together, or could be taken for the mark of a first piece."""
    return text[:1] == "\v" or RUN.search(text) is not None


def pieces(text: str) -> list[str]:
    """Pieces of a text that the pre-tokenizer treats independently of each other, as keys: one that starts with \\v
    stands for what follows it, one that starts with a line break for itself, any other for itself after a space."""
    if _runs(text):
        return ["\v" + p for p in CUT.split(text)]
    return ("\v" + text).replace("\n", " \n").split(" ")


def verbatim(piece: str) -> str:
    return piece[1:] if piece[:1] == "\v" else piece if piece[:1] == "\n" else " " + piece


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    held: list[str] = []
    n = 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


class Recent:
    """The ids, as bytes, of the pieces last seen, in two tables of bounded size: when one is full, it becomes the
    older one, and what is used again moves back. Long pieces stay for one chunk only."""

    def __init__(self, most: int = TABLE_BYTES):
        self.most, self.size = most, 0
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _add(self, found: dict[str, bytes]) -> None:
        self.now.update(found)
        self.size += ENTRY_BYTES * len(found) + sum(map(len, found.values()))

    def ids(self, texts: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of whole texts. encode: gives those of pieces, verbatim, that are not in the tables."""
        if self.size > self.most:
            self.now, self.before, self.size = {}, self.now, 0
        runs = list(map(_runs, texts))
        plain = pa.array(["\v" + t for t, r in zip(texts, runs, strict=True) if not r], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        coded = split.values.dictionary_encode()
        others = [pieces(t) for t, r in zip(texts, runs, strict=True) if r]
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.now.get, keys))
        at = [i for i, x in enumerate(found) if x is None]
        missing = {keys[i] for i in at}.union(k for ps in others for k in ps if k not in self.now)
        old = {k: x for k in missing if (x := self.before.get(k)) is not None}
        self._add(old)
        new = [k for k in missing if k not in old]
        self._add(dict(zip(new, encode(list(map(verbatim, new))), strict=True)))
        get = self.now.__getitem__
        for i in at:
            found[i] = get(keys[i])
        # the ids of all plain texts in a row, gathered from those of the distinct pieces
        size = np.array(list(map(len, found)), np.int32) // 4
        pool = np.frombuffer(b"".join(found), np.uint32)
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.cumsum(n, dtype=np.int32)
        begin = np.cumsum(size, dtype=np.int32) - size
        raw = pool[np.repeat(begin[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)].tobytes()
        cuts = (4 * np.concatenate(([0], ends))[split.offsets.to_numpy()]).tolist()
        whole, rest = (raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)), iter(others)
        out = [b"".join(map(get, next(rest))) if r else next(whole) for r in runs]
        for p in new:
            if len(p) > LONGEST_KEPT:
                self.size -= ENTRY_BYTES + len(self.now.pop(p))
        return out


class MergeReplay:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.vocab[r] = t
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        self.recent = Recent(QUERY_TABLE_BYTES)
        self.decimal = [str(r).encode() for r in range(len(self.vocab))]
        self.pairs, self.pair_ranks = self._mergeable()
        self.seen: dict[tuple[int, int], int] = {}

    def _mergeable(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that are a token together, sorted, and the ranks of these; a last pair that is none."""
        get = self.ranks.get
        found = [
            (a << 32 | b, r) for t, r in self.ranks.items() for i in range(1, len(t))
            if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None
        ]
        found.append((2**63 - 1, NO_RANK))
        pairs, ranks = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True))
        return pairs, ranks.astype(np.int32)

    def _ranks_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the pair at each place, by an index of the pairs: each is looked up once, for all its places."""
        pairs, places = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.pair_ranks[at], NO_RANK)[places]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as bytes."""
        out = [b""] * len(words)
        short, long = [], []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif w:
                (short if len(w) <= SHORT else long).append(i)
        for some, merged in ((short, self._in_waves), (long, self._by_rank)):
            for i, ids in zip(some, merged([words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _in_waves(self, words: list[bytes]) -> list[bytes]:
        """Short words: in each wave, every word's lowest rank is applied."""
        out = [b""] * len(words)
        word = np.arange(len(words))
        size = np.array(list(map(len, words)), np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(len(sym), NO_RANK, np.int32)
        rank[:-1] = self._ranks_at(sym[:-1], sym[1:])
        rank[np.cumsum(size) - 1] = NO_RANK
        while len(word):
            lowest = np.minimum.reduceat(rank, np.cumsum(size) - size)
            done = lowest == NO_RANK
            if done.any():
                of = np.repeat(done, size)
                raw, ends = sym[of].tobytes(), (4 * np.cumsum(size[done])).tolist()
                for i, lo, hi in zip(word[done].tolist(), [0, *ends], ends, strict=False):
                    out[i] = raw[lo:hi]
                sym, rank = sym[~of], rank[~of]
                word, size, lowest = word[~done], size[~done], lowest[~done]
            due = np.repeat(lowest, size)
            at = np.flatnonzero(rank == due)
            # of places that overlap, every other one from the left
            order = np.arange(len(at))
            follows = np.concatenate(([False], at[1:] == at[:-1] + 1))[: len(at)]
            at = at[(order - np.maximum.accumulate(np.where(follows, 0, order))) % 2 == 0]
            sym[at] = due[at]
            size = size - np.bincount(np.repeat(np.arange(len(size)), size)[at], minlength=len(size))
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            sym, rank, at = sym[kept], rank[kept], at - np.arange(len(at))
            # the two neighbours of what was merged are indexed anew
            last = np.zeros(len(sym), bool)
            last[np.cumsum(size) - 1] = True
            rank[at] = NO_RANK
            touched = np.concatenate((at, at[at > 0] - 1))
            touched = touched[~last[touched]]
            rank[touched] = self._ranks_at(sym[touched], sym[touched + 1])
        return out

    def _rank(self, a: int, b: int) -> int:
        r = self.ranks.get(self.vocab[a] + self.vocab[b], -1)
        self.seen[a, b] = r
        return r

    def _by_rank(self, words: list[bytes]) -> list[bytes]:
        """Long words: the index has the places of every rank, and the ranks are applied one after another."""
        pairs, rank = self.seen, self._rank
        byte_ids = self.byte_ids.tolist()
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            sym.extend([byte_ids[b] for b in w])
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts:
            if s < n:
                prv[s] = -1
            if s:
                nxt[s - 1] = -1
        if n:
            nxt[n - 1] = -1
        index: dict[int, list[int]] = {}
        for p in range(n):
            q = nxt[p]
            if q < 0:
                continue
            key = (sym[p], sym[q])
            r = pairs.get(key)
            if r is None:
                r = rank(*key)
            if r >= 0:
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            places.sort()
            for p in places:
                a = sym[p]
                q = nxt[p]
                if a < 0 or q < 0 or pairs.get((a, sym[q])) != r:
                    continue
                sym[p], sym[q] = r, -1
                after = nxt[p] = nxt[q]
                touched = []
                if after >= 0:
                    prv[after] = p
                    touched.append((p, (r, sym[after])))
                before = prv[p]
                if before >= 0:
                    touched.append((before, (sym[before], r)))
                for at, key in touched:
                    s = pairs.get(key)
                    if s is None:
                        s = rank(*key)
                    if s >= 0:
                        if s in index:
                            index[s].append(at)
                        else:
                            index[s] = [at]
                            heapq.heappush(heap, s)
        ends = [*starts[1:], n][: len(starts)]
        return [array("I", [x for x in sym[s:e] if x >= 0]).tobytes() for s, e in zip(starts, ends, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        return [np.frombuffer(x, np.uint32) for x in self.recent.ids(texts, self._new)]

    def _new(self, new: list[str]) -> list[bytes]:
        parts = [[m.encode() for m in self.pattern.findall(p)] for p in new]
        words = list({w for ws in parts for w in ws})
        ids = dict(zip(words, self.replay(words), strict=True))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in parts]

    def decode(self, ids: list[int]) -> bytes:
        vocab = self.vocab
        return b"".join([vocab[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> MergeReplay:
    return MergeReplay(path, pattern)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of `text` as array<int>."""

    def work(texts: list[str | None]) -> tuple[list[np.ndarray]]:
        c = codec(path, pattern)
        return ([x.astype(np.int32) for part in chunks([t or "" for t in texts]) for x in c.encode(part)],)

    return beside(df, [text], [(ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], work)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of `ids` (null: none) as binary."""

    def work(held: list[list[int] | None]) -> tuple[list[bytes]]:
        c = codec(path, pattern)
        return ([b"" if x is None else c.decode(x) for x in held],)

    return beside(df, [ids], [(out, T.BinaryType(), pa.binary())], work)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), default_pattern()

    def work(texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        c = codec(path, pattern)
        decimal = c.decimal
        sizes, written, decoded = [], [], []
        for part in chunks([t or "" for t in texts]):
            for ids in c.encode(part):
                plain = ids.tolist()
                sizes.append(len(plain))
                written.append(hashlib.sha256(b" ".join([decimal[i] for i in plain])).hexdigest())
                decoded.append(hashlib.sha256(c.decode(plain)).hexdigest())
        return sizes, written, decoded

    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hexes = (T.StringType(), pa.string())
    return beside(docs, ["text"], [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", *hexes), ("decoded_sha256", *hexes)], work, dropped=("text",))
