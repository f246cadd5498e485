"""Every opN query on small tables, held against plain Python, the libraries, or its SQL."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hitscope.llm import bpe, pages
from tests.oracle import difference

NAMES = {int(n[2:].split("_")[0]): n for n in entry.queries() if n.startswith("op")}


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(12)
    vocabulary = np.array([f"{a}{b}" for a in ("ta", "mi", "so", "ke", "lu", "ño", "日") for b in ("n", "ra", "sk", "é", "t.", "pp,", "vo")])
    prose = lambda k: " ".join(r.choice(vocabulary, k))
    out = [prose(int(r.integers(1, 220))) for _ in range(70)]
    out += [None, "", " \t\n ", "one", "a a a a a a", "one two", prose(6000), "hi <|endoftext|> there\nand\n\n more", "x" * 3000, out[0], out[0], out[1]]
    shared = prose(50)
    out += [prose(30) + " " + shared + "\n" + prose(20) for _ in range(4)] + [out[2].replace("tan", "TAN", 1), "## $$ " * 60]
    return {7 * i - 20: t for i, t in enumerate(out)}


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, t, ["aa", "bb"][k % 2] if k % 5 else None, "s", len(t or "")) for k, (i, t) in enumerate(texts.items())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    html = [*pages.labelled_pages(20, seed=9), None, "", "<nav><a href=/>Home</a></nav>"]
    spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    turns = [(c, t, "assistant" if t % 2 else "user", f"<|im_end|> {c} &lt; {t}" if t != 3 else None) for c in range(9) for t in range(1 + c)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def rows_of(spark, sf_dir, n):
    return entry.queries()[NAMES[n]](spark, sf_dir).collect()


def test_op1(spark, sf_dir, texts):
    import public_tokenizers
    import tiktoken

    ranks = bpe.codec(bpe.tokenizer_file("byte_bpe_50k.tiktoken"), bpe.default_pattern()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows_of(spark, sf_dir, 1)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        expected[i] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert got == expected


def test_op2(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, 2)}
    assert got.keys() == texts.keys()
    total, slots, shard_of = collections.Counter(), collections.defaultdict(list), {}
    for i, t in texts.items():
        r, raw = got[i], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert 0 <= r["shard"] < 24 and shard_of.setdefault(t or "", r["shard"]) == r["shard"]
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # no group could be moved from the fullest shard to the emptiest without making that one as full
    sizes = collections.Counter()
    for t in texts.values():
        sizes[t or ""] += len((t or "").encode()) + 8
    top = max(total, key=total.get)
    assert min(sizes[t] for t, s in shard_of.items() if s == top) >= total[top] - min(total[k] for k in range(24))


def plain_order_minhash(text):
    """The fingerprint by loops over Python's own lists."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    whole = lambda x: x % 2**64
    long = lambda x, seed: xxhash.xxh64_intdigest(whole(x).to_bytes(8, "little"), seed)
    words = text.encode().split()
    keyed = []
    for i in range(len(words)):
        h = 42
        for w in words[i : i + 3]:
            h = xxhash.xxh64_intdigest(w, h)
        keyed.append(signed(whole(h << 31 | i)))
    seen = collections.Counter()
    renamed = []
    for x in sorted(keyed):
        h, at = x >> 31, x % 2**31
        if seen[h]:
            h = xxhash.xxh64_intdigest(seen[x >> 31].to_bytes(4, "little"), long(h, 42))
        seen[x >> 31] += 1
        renamed.append(signed(whole(h << 31 | at)))
    bins = collections.defaultdict(list)
    for x in sorted(renamed):
        bins[whole(x) >> 58].append(x)
    slots = {}
    for b, xs in bins.items():
        h = 42
        for x in sorted(xs[:2], key=lambda x: x % 2**31):
            h = long(x >> 31, h)
        slots[b] = b << 24 | h >> 40
    return slots


def test_op3(spark, sf_dir, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, 3)}
    shown = lambda slots: {"%08X" % v for v in slots.values()}
    cut = lambda s: {s[i : i + 8] for i in range(0, len(s), 8)}
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        t, u = texts[i] or "", texts[after] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = map(plain_order_minhash, (t, edited, u))
        like = lambda x, y: 1.0 if not x and not y else sum(x.get(k) == v for k, v in y.items()) / len({*x, *y})
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (cut(r["fingerprint"]), cut(r["edited_fingerprint"])) == (shown(a), shown(b))
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))


def test_op4(spark, sf_dir):
    got = {r["page_id"]: r for r in rows_of(spark, sf_dir, 4)}
    assert len(got) == 23 and all(r["n_chars"] == len(r["text"]) and r["url"] == f"http://h/{i}" for i, r in got.items())
    html = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    marked, found = sum(h.count(pages.MARK) for h in html.values()), sum(r["text"].count(pages.MARK) for r in got.values())
    assert [got[i]["text"] for i in (20, 21, 22)] == [""] * 3 and found >= 0.9 * marked


def test_op5(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows_of(spark, sf_dir, 5):
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for parts, most in [*((p, len(ids[i])) for i, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == most if most else at <= 1024
    assert len(sequences) == -(-sum(map(len, ids.values())) // 1024)


def test_op6(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, 6)}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and r["lang_pred"] in ("aa", "bb", "und")


@pytest.mark.parametrize("n", [7, 8, 9])
def test_ops_with_sql(spark, sf_dir, n):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    assert difference(entry.queries()[NAMES[n]](spark, sf_dir), con, entry.oracle_sql()[NAMES[n]]) == ""


def test_op10(spark, sf_dir, texts):
    prints = {}
    for i, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = low.encode().split()
        parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for p in parts:
            h = xxhash.xxh64_intdigest(p, 42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, sf_dir, 10)}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables(spark, sf_dir, tmp_path, n):
    for t in ("documents", "pages", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert entry.queries()[NAMES[n]](spark, str(tmp_path)).count() == (1 if n == 8 else 0)
