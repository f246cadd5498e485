"""Packing by minimum bin slack.

Documents become token ids with one closing id. Full windows are cut off first; what remains of each document
has a length below the window, and only the histogram of those lengths (at most window - 1 counts) reaches the
driver. There, windows are filled one pattern at a time: the longest remaining piece, then the multiset of
remaining lengths that comes closest to the rest of the window, found by a subset-sum dynamic program over a
bitset with backtracked counts; a pattern is used as often as its counts allow. Where no multiset closes the
window exactly, one more piece is cut to close it and its remainder goes back to the histogram. The plan speaks
of ranks within a length; each document finds its own rank, so no task or driver holds the documents.

Defined cases: a null or empty text has only the closing id; repeated rows are packed each; extra columns are
dropped; an empty table gives no rows; a document longer than the window fills several windows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitscope.llm.bpe import QUERY_TABLE_BYTES, TABLE_BYTES, Recent, chunks, tokenizer_file
from hitscope.llm.common import documents, giving_back, materialize

WINDOW, CLOSING = 1024, 0
#: Rows of the table of first ranks up to which it is broadcast (some 40 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Characters of new pieces that the tokenizer gets as one text.
JOINED_CHARS = 4000


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest not over room."""
    full = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # the length, how many of it together, what was reachable before
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return dict(used)


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Where the remainders go: rows (length class, offset in the remainder, first rank, end rank, piece length,
    window of the first rank, offset there), and the number of windows."""
    queues: dict[int, deque] = defaultdict(deque)
    counts: dict[int, int] = {}
    for length, n in histogram.items():
        if n:
            queues[length].append((length, 0, 0, n))
            counts[length] = n
    rows: list[tuple[int, int, int, int, int, int, int]] = []
    bins = 0

    def take(length: int, m: int) -> list[tuple[int, int, int, int]]:
        out = []
        counts[length] -= m
        if not counts[length]:
            del counts[length]
        while m:
            cls, off, lo, hi = queues[length].popleft()
            n = min(m, hi - lo)
            out.append((cls, off, lo, lo + n))
            if lo + n < hi:
                queues[length].appendleft((cls, off, lo + n, hi))
            m -= n
        return out

    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        room = window - longest
        pattern = closest_fill(rest, room) if room else {}
        used = defaultdict(int, pattern)
        used[longest] += 1
        slack = window - sum(k * n for k, n in used.items())
        over = {k: n - used.get(k, 0) for k, n in counts.items() if n > used.get(k, 0)}
        cut = max(over) if slack and over else 0
        if cut:
            used[cut] += 1
        m = min(counts[k] // n for k, n in used.items())
        if cut:
            used[cut] -= 1
        at = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                done = 0
                for cls, off, lo, hi in take(length, m):
                    rows.append((cls, off, lo, hi, length, bins + done, at))
                    done += hi - lo
                at += length
        if cut:
            done = 0
            for cls, off, lo, hi in take(cut, m):
                rows.append((cls, off, lo, hi, slack, bins + done, at))
                done += hi - lo
                queues[cut - slack].append((cls, off + slack, lo, hi))
            counts[cut - slack] = counts.get(cut - slack, 0) + m
        bins += m
    return rows, bins


class Tokens:
    """Ids by the library. New pieces are encoded together, strung into longer texts where that changes no piece's
    ids, and taken apart by their lengths in bytes. A text that holds an added token's string goes to the library
    whole, since the library cuts texts there first."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], np.int64)
        self.recent = Recent(table_bytes)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, new: list[str]) -> list[bytes]:
        """The ids of each piece."""
        out = [b""] * len(new)
        whole = [i for i, s in enumerate(new) if s and (s[0] not in " \n" or s[-1].isspace())]
        for i, ids in zip(whole, self._encoded([new[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        taken = set(whole)
        strung = [i for i, s in enumerate(new) if s and i not in taken]
        texts: list[list[str]] = []
        size = JOINED_CHARS
        for i in strung:
            if size >= JOINED_CHARS:
                texts.append([])
                size = 0
            texts[-1].append(new[i])
            size += len(new[i])
        if strung:
            ids = np.concatenate(self._encoded(["".join(t) for t in texts]))
            ends = np.cumsum([len(new[i].encode()) for i in strung])
            reached = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(reached, ends)
            if last[-1] >= len(ids) or not np.array_equal(reached[last], ends):
                raise ValueError("a token crosses two pieces: this tokenizer is not a byte-level BPE with the usual pattern")
            raw = ids.tobytes()
            at = (4 * (last + 1)).tolist()
            for i, lo, hi in zip(strung, [0, *at], at, strict=False):
                out[i] = raw[lo:hi]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        marked = [any(a in t for a in self.added) for t in texts]
        plain = iter(self.recent.ids([t for t, m in zip(texts, marked, strict=True) if not m], self._new))
        other = iter(self._encoded([t for t, m in zip(texts, marked, strict=True) if m]))
        return [next(other).tobytes() if m else next(plain) for m in marked]


@lru_cache(maxsize=2)
def tokens(path: str, table_bytes: int = TABLE_BYTES) -> Tokens:
    return Tokens(path, table_bytes)


_CUT = pa.schema([
    ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("full_crcs", pa.list_(pa.int64())), ("tail", pa.binary()), ("r", pa.int32()), ("part", pa.int32()), ("rank", pa.int64()), ("full_rank", pa.int64()),
])
_PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _cut(path: str, window: int, table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, part = tokens(path, table_bytes), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        closing = CLOSING.to_bytes(4, "little")
        step = 4 * window
        fulls = 0
        for batch in batches:
            at = 0
            texts = [x or "" for x in batch.column("text").to_pylist()]
            keys = batch.column("doc_id")
            for some in chunks(texts):
                rows = []
                for ids in t.ids(some):
                    ids += closing
                    n = len(ids) // step
                    crcs = [zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(n)]
                    tail = np.frombuffer(ids, "<u4", offset=n * step)
                    r = len(tail)
                    rows.append((len(ids) // 4, crcs, tail.astype("<u2" if not r or tail.max() < 65536 else "<u4").tobytes(), r, part, seen[r], fulls))
                    seen[r] += 1
                    fulls += n
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _CUT.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(some)), *columns], schema=_CUT)
                at += len(some)

    return giving_back(run)


def _place(rows: list[tuple[int, int, int, int, int, int, int]], bins: int, window: int):
    by_class: dict[int, list[tuple[int, int, int, int, int, int]]] = defaultdict(list)
    for cls, *rest in sorted(rows):
        by_class[cls].append(tuple(rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, crcs, tail, r, rank, full in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "full_crcs", "tail", "r", "rank", "full_rank")], strict=True):
                for i, crc in enumerate(crcs):
                    out.append((doc, i * window, window, crc, n, bins + full + i, 0))
                if r:
                    ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * r else "<u4").astype("<u4")
                    base = len(crcs) * window
                    for off, lo, hi, length, first, at in by_class[r]:
                        if lo <= rank < hi:
                            out.append((doc, base + off, length, zlib.crc32(ids[off : off + length].tobytes()), n, first + rank - lo, at))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [()] * len(_PIECE))], schema=_PIECE)

    return giving_back(run)


def pack(docs: DataFrame, path: str, window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, text) to pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. table_bytes: of each of
    a worker's two tables of encoded pieces; the smaller, the more is encoded again."""
    cut = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _cut(path, window, table_bytes),
            "doc_id long, doc_tokens long, full_crcs array<long>, tail binary, r int, part int, rank long, full_rank long",
        ),
        "pack-tokens",
    )
    tails = cut.groupBy("part", "r").agg(F.count(F.lit(1)).alias("n"))
    fulls = cut.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("n"))
    sizes = materialize(tails.unionByName(fulls.select("part", F.lit(-1).alias("r"), "n")), "pack-sizes")
    histogram = {x["r"]: x["n"] for x in sizes.filter("r > 0").groupBy("r").agg(F.sum("n").alias("n")).collect()}
    rows, bins = plan(histogram, window)
    # one row of a part and length: the window of a length holds one small row of each part
    ahead = W.partitionBy("r").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    hint = "broadcast" if sizes.count() <= BROADCAST_ROWS else "merge"
    of_tails = first.filter("r >= 0").select("part", "r", "first").hint(hint)
    of_fulls = first.filter("r < 0").select("part", F.col("first").alias("first_full")).hint(hint)
    ranked = cut.join(of_tails, ["part", "r"]).join(of_fulls, "part").select(
        "doc_id", "doc_tokens", "full_crcs", "tail", "r",
        (F.col("rank") + F.col("first")).cast("long").alias("rank"), (F.col("full_rank") + F.col("first_full")).cast("long").alias("full_rank"),
    )
    return ranked.mapInArrow(_place(rows, bins, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), table_bytes=QUERY_TABLE_BYTES)
