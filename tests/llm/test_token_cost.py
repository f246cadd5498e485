"""What tokenizing costs: how often merges are looked up, and how long finished pieces are kept."""

import numpy as np

from hitscope.llm import bpe, packing


def plain(codec, word):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(codec.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in codec.ranks]
        if not found:
            return [codec.ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def invented(n, seed):
    r = np.random.default_rng(seed)
    syllables = np.array("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ß é 漢 11".split())
    return [" " + "".join(r.choice(syllables, int(k))) for k in r.integers(1, 9, n)]


def test_words_of_a_chunk_are_replayed_together(monkeypatch):
    codec = bpe.MergeReplay(bpe.tokenizer_file("byte_bpe_50k.tiktoken"), bpe.default_pattern())
    words = [w.encode() for w in invented(4000, 1)] + [b"a" * k for k in range(1, 64)] + [b"", b"\xff\x00\xff", b"aba" * 20, b"ab" * 31 + b"c"]
    words += [b"th\xc3\xa9" * 40, b"-" * 300]  # long ones
    calls = []
    ranks_at = bpe.MergeReplay._ranks_at
    monkeypatch.setattr(bpe.MergeReplay, "_ranks_at", lambda self, a, b: calls.append(len(a)) or ranks_at(self, a, b))
    got = codec.replay(words)
    assert len(calls) <= bpe.SHORT
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [plain(codec, w) for w in words]

def test_packing_query_encodes_a_piece_once():
    words = list({"".join(w) for w in invented(400_000, 2)})[:200_000]
    t = packing.Tokens(packing.tokenizer_file("byte_bpe_50k.json"), packing.QUERY_TABLE_BYTES)
    texts = ["".join(words[i : i + 2000]) for i in range(0, len(words), 2000)]
    first = [x for part in bpe.chunks(texts) for x in t.ids(part)]
    encoded = []
    t._new = lambda new, real=t._new: encoded.extend(new) or real(new)
    again = [x for part in bpe.chunks(texts) for x in t.ids(part)]
    assert again == first
    assert not encoded
