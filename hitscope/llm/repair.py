"""Repair of a conversation's structure at least cost, by lazy weighted determinisation.

A repaired conversation's role initials are (s?(ua)+)?. Rows are kept (0), given the role that the structure asks for
(3), deleted (4; a must for blank and repeated rows), and rows without text are inserted (3); a truncated row that stays
adds 3. As an automaton over the rows this is weighted and not deterministic: from each of four states (nothing yet, after
system, user, assistant) several edits lead on. Its determinised form has a vector for a state: what it costs at least to
end well from each of the four, less the smallest of them. The rows are read from the last to the first. Vectors become
states of a table when they are first met, with their transitions for each kind of row, so that the scan is one look-up
a row, and the weights it adds up are the cost. The trace then goes against the scan, from the first row to the last, over
tight arcs, those that lose nothing against the costs still to come; where several are tight it takes the least letter of
D, I, K, R, which gives the least audit of all cheapest ones. Trace steps are cached in the same table.

No conversation is one task's work. Rows are range-partitioned by conversation and turn, so a long conversation lies in
many partitions, as segments. A segment's effect on cost vectors is a 4 by 4 matrix (the scan from each unit vector),
and its effect on the trace a map of the four states; both are folded over the few segments of those conversations that
cross a partition's edge (at most one for each edge). Texts do not go through Python: it sees kinds of rows.

Defined cases: null roles and texts count as one space; null ids of conversations are one conversation; null turns come
first; rows of one turn are in order of role, then text; equal rows of one turn are counted, not sorted out, and all but
one are repetitions; roles of other initials than s, u, a cannot stay; columns besides conv_id, turn, role, text are not
read; an empty table gives no rows. A gap count beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitscope.llm.common import WORD_SPACE, materialize

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NONE = 1 << 40
#: States: nothing yet, after system, after user, after assistant. What each asks for next, and what it may keep.
START, SYSTEM, USER, ASSISTANT = range(4)
ASKED = {START: (USER, "u"), SYSTEM: (USER, "u"), USER: (ASSISTANT, "a"), ASSISTANT: (USER, "u")}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Kinds of rows: the place of the initial here, 4 more if truncated, and one kind that must go.
INITIALS, MUST_GO = "sua?", 8
#: Characters of a text by which rows of one turn and role are dealt out.
DEALT_CHARS = 128


def _closed(v: list[int]) -> list[int]:
    """Costs with insertions counted in."""
    for _ in range(3):
        v = [min(v[q], INSERT + v[ASKED[q][0]], NONE) for q in range(4)]
    return v


#: Costs after the last row: empty and complete conversations are well.
ENDED = _closed([0, NONE, NONE, 0])


class Table:
    """Vectors met so far, numbered, with their transitions and trace steps."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, str, int]] = {}

    def number(self, v: list[int]) -> tuple[int, int]:
        """A vector's number and the weight that normalising takes off."""
        least = min(v)
        key = tuple(NONE if x >= NONE else x - least for x in v)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    def arcs(self, kind: int, q: int) -> list[tuple[str, int, int]]:
        """(edit, cost, next state) for a row of a kind."""
        found = [("D", DELETE, q)]
        if kind != MUST_GO:
            more = TRUNCATED if kind >= 4 else 0
            to = KEPT.get((q, INITIALS[kind % 4]))
            if to is not None:
                found.append(("K", more, to))
            found.append(("R", REROLE + more, ASKED[q][0]))
        return found

    def step(self, after: int, kind: int) -> tuple[int, int]:
        """The vector before a row, given that after it, and the weight that the row adds."""
        got = self.steps.get((after, kind))
        if got is None:
            v = self.vectors[after]
            got = self.steps[after, kind] = self.number(_closed([min(cost + v[to] for _, cost, to in self.arcs(kind, q)) for q in range(4)]))
        return got

    def scan(self, end: int, kinds: list[int]) -> tuple[list[int], int]:
        """The vectors before each row and after the last, and the weight of all rows."""
        states, weight = [end], 0
        for kind in reversed(kinds):
            end, more = self.step(end, kind)
            states.append(end)
            weight += more
        return states[::-1], weight

    def trace(self, after: int, kind: int, q: int) -> tuple[str, str, int]:
        """The edits at a row from state q, the role initials they give ('-' if none), and the state after it."""
        got = self.traces.get((after, kind, q))
        if got is None:
            before, weight = self.step(after, kind)
            v, u = self.vectors[before], self.vectors[after]
            edits, roles, at = "", "", q
            while True:
                arcs = {edit: to for edit, cost, to in self.arcs(kind, at) if cost + u[to] == weight + v[at]}
                if "D" not in arcs and INSERT + v[ASKED[at][0]] == v[at]:
                    at, role = ASKED[at]
                    edits, roles = edits + "I", roles + role
                    continue
                edit = min(arcs)
                roles += {"D": "-", "K": "k", "R": ASKED[at][1]}[edit]
                edits, at = edits + edit, arcs[edit]
                break
            got = self.traces[after, kind, q] = (edits, roles, at)
        return got

    def tail(self, q: int) -> str:
        """The role initials of the rows to insert after the last one."""
        roles = ""
        while q not in (START, ASSISTANT):
            q, role = ASKED[q]
            roles += role
        return roles


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[int], list[int]]]:
    """Rows in order to segments: the first row's columns, the rows' numbers and kinds."""
    head, ats, kinds = None, [], []
    for batch in batches:
        others = [c for c in batch.schema.names if c not in ("at", "kind", "fresh")]
        fresh = batch.column("fresh").to_pylist()
        for i, (at, kind) in enumerate(zip(batch.column("at").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
            if fresh[i]:
                if head is not None:
                    yield head, ats, kinds
                head, ats, kinds = {c: batch.column(c)[i].as_py() for c in others}, [], []
            ats.append(at)
            kinds.append(kind)
    if head is not None:
        yield head, ats, kinds


def _per_segment(tell: Callable[[Table, dict, list[int], list[int]], list[dict]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, told = Table(), []
        for head, ats, kinds in _segments(batches):
            told += tell(table, head, ats, kinds)
            if len(told) >= 10_000:
                yield pa.RecordBatch.from_pylist(told, schema)
                told = []
        yield pa.RecordBatch.from_pylist(told, schema)

    return run


def _matrix(table: Table, head: dict, ats: list[int], kinds: list[int]) -> list[dict]:
    """A segment's matrix by columns: from each state before it to one state after it."""
    columns = []
    for q in range(4):
        end, _ = table.number([0 if p == q else NONE for p in range(4)])
        states, weight = table.scan(end, kinds)
        columns.append([NONE if x == NONE else x + weight for x in table.vectors[states[0]]])
    return [{"run": head["run"], "part": head["part"], "columns": columns}]


def _exits(table: Table, head: dict, ats: list[int], kinds: list[int]) -> list[dict]:
    """The state after a segment, for each one before it."""
    states, _ = table.scan(table.number(head["costs"])[0], kinds)
    out = []
    for q in range(4):
        for after, kind in zip(states[1:], kinds, strict=True):
            q = table.trace(after, kind, q)[2]
        out.append(q)
    return [{"run": head["run"], "part": head["part"], "exits": out}]


def _edits(table: Table, head: dict, ats: list[int], kinds: list[int]) -> list[dict]:
    """The edits at each row of a segment."""
    states, _ = table.scan(table.number(head["costs"] or ENDED)[0], kinds)
    q, out = head["entry"] or START, []
    for at, after, kind in zip(ats, states[1:], kinds, strict=True):
        edits, roles, q = table.trace(after, kind, q)
        out.append({"at": at, "edits": edits, "roles": roles, "tail": ""})
    if head["last"] is not False:
        out[-1]["tail"] = table.tail(q)
    return out


def _fold_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Segments of one conversation: the costs after each of them."""
    pdf = pdf.sort_values("part")
    now, out = ENDED, []
    for columns in reversed(list(pdf["columns"])):
        least = min(now)
        now = [x - least for x in now]
        out.append(now)
        now = _closed([min(min(int(columns[to][q]) + now[to], NONE) for to in range(4)) for q in range(4)])
    return pd.DataFrame({"run": pdf["run"], "part": pdf["part"], "costs": out[::-1], "last": [False] * (len(out) - 1) + [True]})


def _fold_states(pdf: pd.DataFrame) -> pd.DataFrame:
    """Segments of one conversation: the state before each of them."""
    pdf = pdf.sort_values("part")
    entry = [START]
    for exits in pdf["exits"]:
        entry.append(int(exits[entry[-1]]))
    return pd.DataFrame({"run": pdf["run"], "part": pdf["part"], "entry": entry[:-1]})


def _ranged(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies), equal ones as one, numbered by `at` in order; part: their partition."""
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, DEALT_CHARS)]
    dealt = each.repartitionByRange(parts, *keys) if parts else each.repartitionByRange(*keys)
    numbered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
    return materialize(numbered.withColumn("part", F.shiftright("at", 33).cast("int")), "repair-rows")


def edited(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) without nulls in role, text, copies to what becomes of them, in the order
    of `at`: of the first copy by `edits` (letters; I comes before the row), `roles` (their initials; k: its own) and
    `tail` (initials of rows inserted after it); all other copies are deleted. blank, duplicate, truncated, illegal:
    counts over the copies; cost: of all edits here. parts: how many ranges, for tests."""
    base = _ranged(rows, parts)
    firsts = base.groupBy("conv_id", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(7), "text", "role").alias("g")).agg(F.min("at").alias("at"))
    bare = F.rtrim(F.col("text"), F.lit(WORD_SPACE))
    initial = F.substring("role", 1, 1)
    place = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), initial), F.lit(0)) - 1, F.lit(3))
    named = (
        base.join(firsts.select("at", F.lit(True).alias("first")), "at", "left")
        .withColumn("is_blank", bare == "")
        .withColumn("cut", ~F.substring(bare, -1, 1).isin(".", "!", "?"))
        .withColumn("live", F.col("first").isNotNull() & ~F.col("is_blank"))
        .select(
            "at", "part", "conv_id", initial.alias("initial"),
            F.when(~F.col("live"), MUST_GO).otherwise(F.when(initial == "", 3).otherwise(place) + F.when(F.col("cut"), 4).otherwise(0)).cast("int").alias("kind"),
        )
    )
    named = materialize(named, "repair-kinds")
    crossing = named.groupBy("conv_id").agg(F.min("part").alias("run"), F.max("part").alias("end")).filter("run < end").select("conv_id", "run")
    # one conversation at most crosses each edge between two partitions, so these tables have no more rows than twice the partitions
    crossing = F.broadcast(materialize(crossing, "repair-crossing").withColumnRenamed("conv_id", "_conv"))
    order = W.partitionBy("part").orderBy("at")
    back = F.lag(F.struct("conv_id", "initial")).over(order)
    placed = named.withColumn("back", back).withColumn("fresh", F.col("back").isNull() | ~F.col("back.conv_id").eqNullSafe(F.col("conv_id")))
    placed = placed.join(crossing, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    shape = lambda *own: pa.schema([("run", pa.int32()), ("part", pa.int32()), *own])
    across = placed.filter("run is not null")
    matrices = across.select("at", "kind", "fresh", "run", "part").mapInArrow(_per_segment(_matrix, shape(("columns", pa.list_(pa.list_(pa.int64()))))), "run int, part int, columns array<array<long>>")
    costs = materialize(matrices.groupBy("run").applyInPandas(_fold_costs, "run int, part int, costs array<long>, last boolean"), "repair-costs")
    known = across.join(F.broadcast(costs), ["run", "part"])
    exits = known.select("at", "kind", "fresh", "run", "part", "costs").mapInArrow(_per_segment(_exits, shape(("exits", pa.list_(pa.int64())))), "run int, part int, exits array<long>")
    entries = exits.groupBy("run").applyInPandas(_fold_states, "run int, part int, entry int")
    ends = across.groupBy("run", "part").agg(F.max_by("initial", "at").alias("initial"))
    before = ends.select("run", "part", F.lag("initial").over(W.partitionBy("run").orderBy("part")).alias("before"))
    info = materialize(costs.join(entries, ["run", "part"]).join(before, ["run", "part"]), "repair-segments")
    told = placed.join(F.broadcast(info), ["run", "part"], "left").select("at", "kind", "fresh", "costs", "last", "entry")
    shown = pa.schema([("at", pa.int64()), ("edits", pa.string()), ("roles", pa.string()), ("tail", pa.string())])
    edits = told.mapInArrow(_per_segment(_edits, shown), "at long, edits string, roles string, tail string")
    left = F.when(~F.col("fresh"), F.col("back.initial")).otherwise(F.col("before"))
    pairs = placed.join(F.broadcast(info.select("run", "part", "before")), ["run", "part"], "left").select(
        "at", "kind", (left.isNotNull() & ~F.concat(left, "initial").isin("su", "ua", "au")).cast("long").alias("broken")
    )
    count = lambda s, letters: F.char_length(s) - F.char_length(F.translate(s, letters, ""))
    live, stays = F.col("kind") != MUST_GO, count(F.col("edits"), "KR")
    blank = bare == ""
    return base.join(pairs, "at").join(edits, "at").select(
        "at", "part", "conv_id", "turn", "role", "text", "copies", "edits", "roles", "tail",
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"),
        F.when(blank, 0).otherwise(F.col("copies") - live.cast("long")).alias("duplicate"),
        (live & (F.col("kind") >= 4)).cast("long").alias("truncated"),
        (F.col("broken") + F.col("copies") - 1).alias("illegal"),
        (
            DELETE * (count(F.col("edits"), "D") + F.col("copies") - 1) + INSERT * (count(F.col("edits"), "I") + F.char_length("tail")) + REROLE * count(F.col("edits"), "R")
            + F.when(live & (F.col("kind") >= 4), TRUNCATED * stays).otherwise(0)
        ).cast("long").alias("cost"),
    )


def _name(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


def _steps() -> Column:
    """The edits at a row of `edited`, as array<struct<edit, role, text>>; deleted rows have their own role and text."""
    letters = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    inserted = lambda r: F.struct(F.lit("I").alias("edit"), _name(r).alias("role"), F.lit("").alias("text"))
    own = F.transform(
        F.arrays_zip(letters(F.col("edits")).alias("e"), letters(F.col("roles")).alias("r")),
        lambda x: F.when(x["e"] == "I", inserted(x["r"])).otherwise(
            F.struct(x["e"].alias("edit"), F.when(x["e"] == "R", _name(x["r"])).otherwise(F.col("role")).alias("role"), F.col("text").alias("text"))
        ),
    )
    gone = F.struct(F.lit("D").alias("edit"), F.col("role").alias("role"), F.col("text").alias("text"))
    return F.concat(own, F.array_repeat(gone, (F.col("copies") - 1).cast("int")), F.transform(letters(F.col("tail")), inserted))


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row for each edit: (conv_id, place long, step int, edit, role, text). In order of
    place and step, the rows of a conversation that are not D are the repaired one."""
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).cast("long").alias("copies"))
    return edited(rows).select("conv_id", F.col("at").alias("place"), F.posexplode(_steps()).alias("step", "s")).select("conv_id", "place", "step", "s.*")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of conversation and turn, as (conv_id, turn, role, text, copies)."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(written("text"), ".!?", "")).otherwise(written("text"))
    return conversations.filter(h != 0).select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(written("role")).alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).cast("long").alias("copies")
    )


def summary(conversations: DataFrame, rows: DataFrame, parts: int | None = None) -> DataFrame:
    """What repair of the rows (conv_id, turn, role, text, copies) finds and does, for each conv_id of conversations.

    Segments of a conversation are put together first, so what one task gathers of one is its segments' digests, and the
    repaired text itself only where it is hashed."""
    got = materialize(edited(rows, parts), "repair-edited")
    step = F.struct("at", F.concat("edits", F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int")), F.repeat(F.lit("I"), F.char_length("tail"))).alias("audit"), _steps().alias("steps"))
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    segment = got.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in sums], F.sort_array(F.collect_list(step)).alias("s"))
    kept = F.filter(F.flatten("s.steps"), lambda x: x["edit"] != "D")
    lines = F.transform(kept, lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    segment = segment.select("conv_id", "part", *sums, F.array_join("s.audit", "").alias("audit"), F.when(F.size(kept) > 0, F.array_join(lines, "\n")).alias("lines"))
    piece = F.sort_array(F.collect_list(F.struct("part", "audit", "lines")))
    whole = segment.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in sums], piece.alias("p")).select(
        "conv_id", *sums, F.array_join("p.audit", "").alias("audit"), F.sha2(F.array_join(F.array_compact("p.lines"), "\n").cast("binary"), 256).alias("repaired_sha256")
    )
    turns = got.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("n"))
    span = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1 - F.col("n")
    turns = turns.select(F.col("conv_id").alias("_t"), F.when(F.col("n") == 0, 0).otherwise(span.try_cast("bigint")).alias("gaps"))
    every = conversations.select(F.col("conv_id").alias("_c")).distinct()
    joined = every.join(whole, F.col("_c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(turns, F.col("_c").eqNullSafe(F.col("_t")), "left")
    none = F.col("audit").isNull()
    zero = [F.when(none, 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("gaps", *sums)]
    return joined.select(
        F.col("_c").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return summary(conversations, damaged(conversations))
