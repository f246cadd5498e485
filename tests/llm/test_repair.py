"""Conversation repair against a plain dynamic programme over (cost, audit) pairs."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hitscope.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        yield from [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)


def plain_repair(rows):
    """rows: (turn, role, text) in order. (blank, duplicate, truncated, illegal, cost, audit, lines)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    asked = {"": "u", "s": "u", "u": "a", "a": "u"}

    best = {}
    for i in range(len(rows), -1, -1):
        for depth in range(6):  # insertions in a row; more than a few are never cheapest
            for q in ("", "s", "u", "a"):
                found = [best[i, q]] if (i, q) in best else []
                if i == len(rows) and q in ("", "a"):
                    found.append((0, "", ()))
                if (i, asked[q]) in best:
                    cost, audit, lines = best[i, asked[q]]
                    found.append((cost + 3, "I" + audit, ({"u": "user", "a": "assistant"}[asked[q]] + ":",) + lines))
                if i < len(rows):
                    _, role, text = rows[i]
                    cost, audit, lines = best[i + 1, q]
                    found.append((cost + 4, "D" + audit, lines))
                    if faults[i] not in ("blank", "duplicate"):
                        more = 3 if faults[i] == "truncated" else 0
                        if (q, role[:1]) in legal:
                            cost, audit, lines = best[i + 1, legal[q, role[:1]]]
                            found.append((cost + more, "K" + audit, (f"{role}:{text}",) + lines))
                        cost, audit, lines = best[i + 1, asked[q]]
                        found.append((cost + more + 3, "R" + audit, ({"u": "user", "a": "assistant"}[asked[q]] + ":" + text,) + lines))
                if found:
                    best[i, q] = min(found)
    cost, audit, lines = best[0, ""]
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines


def plain(table):
    out = {}
    held = list(plain_damage(table))
    for conv in {r[0] for r in table}:
        rows = sorted(((t, r, x) for c, t, r, x in held if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        *counts, audit, lines = plain_repair(rows)
        out[conv] = (gaps, *counts, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def of(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def table(seed, conversations, longest):
    r = random.Random(seed)
    rows = []
    for conv in conversations:
        turn = r.randrange(-2, 3)
        for _ in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None, "ua"])
            text = r.choice(["ok.", "yes!", "cut", "a b?", "", " \t", "é… 日本.", "x" * 300 + ".", "ok."]) + r.choice(["", str(r.random()) + "."]) if r.random() < 0.9 else None
            rows.append((conv, None if r.random() < 0.05 else turn, role, text))
            turn += r.choice([1, 1, 1, 0, 3])
    return rows


@pytest.mark.parametrize("parts", [None, 7])
def test_against_plain(spark, parts):
    rows = table(3, [*range(60), None, 10**17], 14)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert of(repair.summary(df, repair.damaged(df), parts)) == plain(rows)


def test_a_conversation_over_many_partitions(spark):
    rows = table(4, [7], 400) + table(5, [6, 8], 5) + [(9, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    damaged = repair.damaged(df)
    assert of(repair.summary(df, damaged, 9)) == plain(rows)
    held = repair.edited(damaged, 9)
    assert held.filter("conv_id = 9").select("part").distinct().count() > 2


def test_rows_of_the_repaired_conversation(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "system", "s."), (3, 0, "user", ""), (4, 1, "user", "q?"), (4, 2, "assistant", "cut")]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place", "step").collect()
    of_one = lambda c: [(r["edit"], r["role"], r["text"]) for r in got if r["conv_id"] == c]
    assert of_one(1) == [("K", "user", "a."), ("I", "assistant", ""), ("K", "user", "b."), ("I", "assistant", "")] or of_one(1) == [("K", "user", "a."), ("R", "assistant", "b.")]
    assert of_one(1) == [("K", "user", "a."), ("R", "assistant", "b.")]
    assert of_one(2) == [("D", "system", "s.")]
    assert of_one(3) == [("D", "user", "")]
    assert of_one(4) == [("K", "user", "q?"), ("K", "assistant", "cut")]


def test_table_stays_small():
    table_ = repair.Table()
    end, _ = table_.number(repair.ENDED)
    r = random.Random(1)
    for _ in range(200):
        table_.scan(end, [r.randrange(9) for _ in range(50)])
    assert len(table_.vectors) < 100


def test_empty_and_extreme(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.summary(none, repair.damaged(none)).count() == 0
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, None, "user", "c.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("own")).withColumn("at", F.lit(1)).withColumn("copies", F.lit("x"))
    got = {r["conv_id"]: r["gaps"] for r in repair.summary(df, repair.damaged(df)).collect()}
    assert got == {1: None if all(zlib.crc32(f"1:{t}".encode()) % 20 for t in (-(2**63), 2**63 - 1)) else 0, 2: 0}


def test_whole_ids(spark):
    rows = [(2**53 + 1, 0, "user", "a?"), (2**53 + 3, 0, "user", "b?"), (None, 0, "user", "c?")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert of(repair.summary(df, repair.damaged(df))).keys() == {2**53 + 1, 2**53 + 3, None}


