"""User-agent classification for long registries: one pass over an agent instead of one test for each entry.

All tokens, strong and weak, and the literal signs of automation stand in one Aho-Corasick automaton over the agent in
ASCII lower case; of the tokens found, the leftmost counts, and the longest of those. A second automaton holds, for each
pattern, literals of which its every match contains one, read off its parse tree; only patterns whose literal is in the
agent are tried, in their order, and the few without one. The stages are those of `agents.classify`.

Each distinct agent is classified once, in Arrow batches; the automata are built once in a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hitscope.functions.agents import DEVICES, GENERIC_SIGNS, META, stages

try:
    from re import _constants as codes
    from re import _parser as parser
except ImportError:  # older names
    import sre_constants as codes
    import sre_parse as parser

Result = tuple[str, str, str]
HUMAN, BOT = ("human", "", ""), ("other_bot", "", "")
#: A pattern's literals are of use from this length on.
LEAST_LITERAL = 3
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_LOWER)


def _literals(tree: Any) -> set[str] | None:
    """Strings of which every match of a parsed pattern contains one; None if none are known."""
    found: list[set[str]] = []
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is codes.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append({run})
            run = ""
        inner = None
        if op is codes.SUBPATTERN and not arg[1] and not arg[2]:
            inner = _literals(arg[3])
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT) and arg[0] >= 1:
            inner = _literals(arg[2])
        elif op is codes.BRANCH:
            ways = [_literals(way) for way in arg[1]]
            inner = set().union(*ways) if all(ways) else None
        if inner:
            found.append(inner)
    return max(found, key=lambda s: min(map(len, s)), default=None)


def needed(pattern: str) -> set[str]:
    """Literals of which a match of the pattern contains one at least, each long enough to be of use; empty if there are none."""
    tree = parser.parse(pattern, re.ASCII)
    if tree.state.flags & re.IGNORECASE:
        return set()
    found = _literals(tree)
    return found if found and min(map(len, found)) >= LEAST_LITERAL else set()


def _automaton(values: dict[str, Any]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, value in values.items():
        made.add_word(word, (len(word), value))
    made.make_automaton()
    return made


class AgentIndex:
    """classify() of one agent at a time."""

    def __init__(self, bots: list[dict[str, Any]]) -> None:
        strong, patterns, weak = stages(bots)
        plain = [s for s in GENERIC_SIGNS if not META.search(s.replace("\\/", "/"))]
        words: dict[str, list[Any]] = {}
        for place, table in enumerate((strong, weak)):
            for token, result in table.items():
                words.setdefault(_lower(token), [None, None, False])[place] = result
        for sign in plain:
            words.setdefault(_lower(sign), [None, None, False])[2] = True
        self.words = _automaton(words)
        self.signs = re.compile("|".join(s for s in GENERIC_SIGNS if s not in plain), re.IGNORECASE | re.ASCII)
        self.device = re.compile(DEVICES, re.ASCII)
        self.patterns = [(re.compile(p, re.ASCII), result) for p, result in patterns]
        of_literal: dict[str, list[int]] = {}
        self.always = []
        for i, (p, _) in enumerate(patterns):
            held = needed(p)
            for s in held:
                of_literal.setdefault(s, []).append(i)
            if not held:
                self.always.append(i)
        self.literals = _automaton(of_literal) if of_literal else None

    def of(self, ua: str | None) -> Result:
        if ua is None or ua.strip(" ") in ("", "-"):
            return BOT
        low = _lower(ua)
        strong: tuple[int, int, Result] | None = None
        weak: tuple[int, int, Result] | None = None
        sign = False
        if len(self.words):
            for end, (size, (s, w, g)) in self.words.iter(low):
                at = (end - size, -size)
                if s is not None and (strong is None or at < strong[:2]):
                    strong = (*at, s)
                if w is not None and (weak is None or at < weak[:2]):
                    weak = (*at, w)
                sign = sign or g
        if strong is not None:
            return strong[2]
        tried = self.always
        if self.literals is not None:
            more = {i for _, (_, held) in self.literals.iter(ua) for i in held}
            tried = sorted(more.union(tried)) if more else tried
        for i in tried:
            p, result = self.patterns[i]
            if p.search(ua):
                return result
        if "cubot" in low and self.device.search(ua):
            return HUMAN
        if weak is not None:
            return weak[2]
        return BOT if sign or "bot" in low and self.signs.search(ua) else HUMAN


@lru_cache(maxsize=4)
def _index(key: tuple[tuple[Any, ...], ...]) -> AgentIndex:
    return AgentIndex([{"bot_id": b, "operator": o, "actor_type": a, "ua_patterns": list(p)} for b, o, a, p in key])


def classified(agents: DataFrame, bots: list[dict[str, Any]], ua: str = "ua") -> DataFrame:
    """agents, rows of distinct agents best, with actor_type, bot_id and operator (unknown is '')."""
    key = tuple((e["bot_id"], e["operator"], e["actor_type"], tuple(e["ua_patterns"])) for e in bots)
    added = ("actor_type", "bot_id", "operator")
    own = [f for f in agents.schema.fields if f.name not in added]
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key)
        for batch in batches:
            found = list(map(index.of, batch.column(ua).to_pylist()))
            columns = [pa.array([r[i] for r in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, [*names, *added])

    schema = T.StructType([*own, *[T.StructField(c, T.StringType()) for c in added]])
    return agents.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)
