"""Personal data in texts, and the terms that give it away, by information content. Built-in functions only.

Four kinds of identifiers are found by pattern: e-mail addresses, IPv4 addresses, card numbers, phone numbers. Each
distinct one is a protected entity c. The corpus then tells how strongly a term t reveals it: with p(c), p(t), p(c, t)
the shares of documents that hold c, hold t, and hold t within WINDOW terms of c, the disclosure of c by t is
PMI(c; t) / IC(c) = log2(p(c, t) / (p(c) p(t))) / -log2 p(c), which is 1 if every document with t has c beside it. Terms
that stand beside c in at least LEAST_WINDOWS different windows (so that copies of one text prove nothing) and disclose
it by GENERALISED or more are replaced by what kind of term they are, by REMOVED or more taken out, wherever they stand.

Counts are aggregated before each shuffle; no pairs of documents or of terms are formed beyond the windows. Revealing
terms are looked up in the texts by a broadcast if there are BROADCAST_TERMS at most, and else by a salted shuffle.

Places are counted in code points. Patterns are written so that no text takes more than time in proportion to its
length: a match begins where a run of its characters begins, or where the match before it ended.

Defined cases: a null text is empty; an empty table gives no rows; repeated rows are treated alike; columns besides
doc_id and text stay as they are (`sanitised` replaces spans and clean_text only). A term's place inside or across an
identifier's does not count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitscope.functions.ip import let
from hitscope.llm.common import documents, materialize, unused

#: Terms on each side of an identifier; different windows that must show a term beside it; thresholds of disclosure.
WINDOW, LEAST_WINDOWS, GENERALISED, REMOVED = 6, 3, 0.95, 0.98
TERM = r"[\p{L}\p{N}]{3,}"
BROADCAST_TERMS, SALTS = 200_000, 16
#: Elements of a chunk in `scanned`, code points of a block in `_replaced`.
CHUNK, BLOCK = 64, 2048

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What terms and windows are outside of: every kind of match, but only runs of digits that are long enough for a card.
ANY = "|".join([PATTERNS["email"], PATTERNS["ip"], PATTERNS["phone"], "[0-9](?:[ -]?[0-9]){12,}+"])
KINDS = [*PATTERNS, "term"]
#: The same as PATTERNS for a text in which no identifier of a kind can be.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
SPAN = "array<struct<start:int,end:int,match:string>>"


def scanned(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running results of an array<int> under op (a sum or a maximum of values from 0 on), by chunks and then within them."""
    fold = lambda a: F.aggregate(a, F.lit(0), op)
    chunks = lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: fold(F.slice(a, c * CHUNK + 1, CHUNK)))
    )

    def of(a: Column) -> Column:
        return let(chunks(a), lambda t: let(F.transform(t, lambda _, c: fold(F.slice(t, 1, c))), lambda before: F.transform(
            a, lambda _, i: op(F.get(before, F.floor(i / CHUNK).cast("int")), fold(F.slice(a, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK + 1)))
        )))

    return let(values, of)


def spans_of(text: Column, pattern: str | Column) -> Column:
    """All leftmost matches that do not overlap, with their places."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.struct(F.split(text, p, -1).alias("between"), F.regexp_extract_all(text, p, F.lit(0)).alias("found"))

    def placed(x: Column) -> Column:
        steps = F.transform(x["found"], lambda m, i: F.char_length(F.get(x["between"], i)) + F.char_length(m))
        return let(scanned(steps, lambda a, b: a + b), lambda ends: F.transform(
            x["found"], lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"))
        ))

    return let(parts, placed)


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c < "5", 2 * c.cast("int")).otherwise(2 * c.cast("int") - 9)
    return F.aggregate(F.transform(_characters(F.reverse(digits)), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return let(F.translate(match, " -", ""), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _may(kind: str, text: Column) -> Column:
    """Whether a text has the characters that a kind needs; cheap."""
    sign = NEEDS.get(kind)
    has_sign = F.contains(text, F.lit(sign)) if sign else F.lit(True)
    return has_sign if kind == "email" else has_sign & text.rlike("[0-9]")


def identifiers(text: Column, kind: str) -> Column:
    """The valid identifiers of a kind in a text that is not null."""
    return F.when(_may(kind, text), F.filter(spans_of(text, PATTERNS[kind]), lambda s: is_valid(kind, s["match"]))).otherwise(F.array().cast(SPAN))


def _entity(match: Column) -> Column:
    """What a match of ANY stands for, written alike wherever it is the same; null if it is not valid."""
    named = lambda kind, value: F.concat(F.lit(kind + ":"), value)
    return (
        F.when(F.contains(match, F.lit("@")), named("email", F.lower(match)))
        .when(F.startswith(match, F.lit("+")), F.when(is_valid("phone", match), named("phone", F.translate(match, "+ ().-", ""))))
        .when(F.contains(match, F.lit(".")), F.when(is_valid("ip", match), named("ip", match)))
        .when(is_valid("card", match), named("card", F.translate(match, " -", "")))
    )


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def _may_any(text: Column) -> Column:
    return F.contains(text, F.lit("@")) | text.rlike("[0-9]")


def _bare_terms(text: Column) -> Column:
    """The distinct terms of a text outside matches of ANY."""
    bare = F.when(_may_any(text), F.array_join(F.split(text, ANY, -1), " ")).otherwise(text)
    return F.array_distinct(_terms(bare))


def _beside(text: Column) -> Column:
    """What a document tells: (entity, term, window) for each term beside an entity, (entity, term, null) once for each
    pair, (entity, '', null) once for each entity."""
    parts = F.struct(F.transform(F.split(text, ANY, -1), _terms).alias("between"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found"))

    def windows(x: Column) -> Column:
        before = lambda i: let(F.get(x["between"], i), lambda t: F.slice(t, F.greatest(F.size(t) - WINDOW, F.lit(0)) + 1, WINDOW))
        after = lambda i: F.slice(F.get(x["between"], i + 1), 1, WINDOW)
        return F.filter(F.transform(x["found"], lambda m, i: F.struct(_entity(m).alias("entity"), before(i).alias("before"), after(i).alias("after"))), lambda w: w["entity"].isNotNull())

    row = lambda w, term, window: F.struct(w["entity"].alias("entity"), term.alias("term"), window.alias("window"))
    none = F.lit(None).cast("long")
    told = lambda w: F.concat(
        F.array(row(w, F.lit(""), none)),
        F.flatten(F.transform(F.array_distinct(F.concat(w["before"], w["after"])), lambda t: F.array(row(w, t, none), row(w, t, F.xxhash64(w["before"], w["after"]))))),
    )
    return let(parts, lambda x: F.array_distinct(F.flatten(F.transform(windows(x), told))))


def _held(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (term, ...) whose term is in terms, which are distinct and stored, with the columns of terms."""
    if terms.count() <= BROADCAST_TERMS:
        return rows.join(F.broadcast(terms), "term")
    salted = terms.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).drop("_salt")


def disclosures(texts: DataFrame, least_windows: int = LEAST_WINDOWS) -> DataFrame:
    """(text) rows, none null, to (entity, term, windows, n_both, n_entity, n_term, disclosure) for terms in so many windows of an entity."""
    total = texts.count()
    told = texts.filter(_may_any(F.col("text"))).select(F.explode(_beside(F.col("text"))).alias("t")).select("t.*")
    counted = told.groupBy("entity", "term", "window").agg(F.count(F.lit(1)).alias("n"))
    pairs = counted.groupBy("entity", "term").agg(F.count("window").alias("windows"), F.sum(F.when(F.col("window").isNull(), F.col("n"))).alias("n_both"))
    pairs = materialize(pairs.filter((F.col("term") == "") | (F.col("windows") >= least_windows)), "privacy-pairs")
    entities = pairs.filter("term = ''").select("entity", F.col("n_both").alias("n_entity"))
    beside = pairs.filter("term != ''")
    # counted whole and then joined, so that the join has no more rows than pairs; a semi-join would be moved below the count
    n_term = texts.select(F.explode(_bare_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    content = F.log2(F.lit(float(total)) / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    return beside.join(entities, "entity").join(n_term, "term").select(
        "entity", "term", "windows", "n_both", "n_entity", "n_term", F.when(content > 0, F.round(shared / content, 9)).otherwise(0.0).alias("disclosure")
    )


def revealing(texts: DataFrame, generalised: float = GENERALISED, least_windows: int = LEAST_WINDOWS) -> DataFrame:
    """(term, disclosure): the terms that disclose some entity by `generalised` or more, with the most they disclose."""
    found = disclosures(texts, least_windows).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return materialize(found.filter(F.col("disclosure") >= generalised), "privacy-revealing")


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with each span, of those in order of their starts, replaced; of overlapping ones, all by the first's replacement."""

    def between(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        inside = F.substring(F.get(blocks, first), start % BLOCK + 1, end - start)
        across = F.concat(
            F.substring(F.get(blocks, first), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
            F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end % BLOCK), F.lit("")),
        )
        return F.when(start >= end, "").when(first == last, inside).otherwise(across)

    def joined(blocks: Column, s: Column, reach: Column) -> Column:
        done = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        pieces = F.transform(s, lambda x, i: F.concat(between(blocks, done(i), x["start"]), F.when(x["start"] >= done(i), by(x)).otherwise("")))
        return F.concat(F.array_join(pieces, ""), between(blocks, done(F.size(s)), F.char_length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = lambda s: scanned(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    changed = let(blocks, lambda b: let(spans, lambda s: let(ends(s), lambda reach: joined(b, s, reach))))
    return F.when(F.size(spans) == 0, text).otherwise(changed)


def _general(x: Column) -> Column:
    """What stands for a span: its kind; for a term, nothing or the kind of term it is."""
    shape = F.when(x["match"].rlike(r"^\p{N}+$"), "[number]").when(x["match"].rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")
    return F.when(x["kind"] != "term", F.concat(F.lit("["), x["kind"], F.lit("]"))).when(x["removed"], "").otherwise(shape)


def sanitised(docs: DataFrame, revealed: DataFrame | None = None, removed: float = REMOVED) -> DataFrame:
    """docs (text, ...) with `spans`, array<struct<start, end, match, kind, removed>> by kind as in KINDS and then place, and
    `clean_text`. revealed: what `revealing` gives; it is found in docs themselves if left out."""
    own = [c for c in docs.columns if c not in ("spans", "clean_text")]
    body, marks, a, b = (unused(c, docs.columns) for c in ("_body", "_marks", "_a", "_b"))
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce("text", F.lit("")).alias(body))
    if revealed is None:
        revealed = revealing(rows.select(F.col(body).alias("text")))
    keys = [F.xxhash64(body).alias(a), F.xxhash64(F.lit(7), F.col(body)).alias(b)]
    if revealed.isEmpty():
        rows = rows.withColumn(marks, F.lit(None).cast("array<struct<term:string,removed:boolean>>"))
    else:
        terms = revealed.select("term", (F.col("disclosure") >= removed).alias("removed"))
        held = _held(rows.select(*keys, F.explode(_bare_terms(F.col(body))).alias("term")), terms)
        texts = materialize(held.groupBy(a, b).agg(F.collect_set(F.struct("term", "removed")).alias(marks)), "privacy-marks")
        rows = rows.select("*", *keys)
        if texts.agg(F.coalesce(F.sum(F.size(marks)), F.lit(0))).first()[0] <= BROADCAST_TERMS:
            rows = rows.join(F.broadcast(texts), [a, b], "left").drop(a, b)
        else:  # a text may have very many copies
            salt = unused("_salt", rows.columns)
            spread = texts.withColumn(salt, F.explode(F.array(*map(F.lit, range(SALTS)))))
            rows = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(spread, [a, b, salt], "left").drop(a, b, salt)
    text = F.col(body)
    of_kind = lambda s, kind: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), F.lit(kind).alias("kind"), F.lit(True).alias("removed")))
    base = F.concat(*[of_kind(identifiers(text, k), k) for k in PATTERNS])
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.col(f"{marks}.term"), "|"), F.lit(r")(?![\p{L}\p{N}])"))

    def with_terms(found: Column) -> Column:
        away = lambda t: ~F.exists(found, lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"]))
        out = lambda t: F.exists(F.col(marks), lambda m: (m["term"] == t["match"]) & m["removed"])
        more = F.transform(F.filter(spans_of(text, pattern), away), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["match"].alias("match"), F.lit("term").alias("kind"), out(t).alias("removed")))
        return F.when(F.col(marks).isNull(), found).otherwise(F.concat(found, more))

    marked = rows.withColumn("spans", let(base, with_terms))
    # the row number, always true here, keeps the optimizer from copying the spans to each of their uses
    marked = marked.withColumn("spans", F.when(F.monotonically_increasing_id() >= 0, F.col("spans")))
    by_place = F.array_sort("spans", lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"]))
    return marked.withColumn("clean_text", _replaced(text, by_place, _general)).select(*[F.col(f"`{c}`") for c in own], "spans", "clean_text")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sanitised(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "term")
    return got.select(
        "doc_id", *map(count, PATTERNS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        count("term"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"),
    )
