"""Quality rules as a bitmask ledger.

Each document is measured once; every rule's failure is one bit of `failed`. A policy is a named,
versioned mask: applying it, or asking what dropping one rule would change, is bit arithmetic over
the ledger, never a second look at the text.

Defined cases: a null or blank text has no words and fails `few_words`; repeated rows are judged
alike; extra columns are untouched by `measure` unless they carry a measurement's name, which it
replaces; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitscope.llm.common import WORD_SPACE, documents, unused, words

SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower"]

#: Rule name to the condition under which a document fails it; a rule's bit is its place here.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "20 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 30 * n_words)",
    "shouting": "n_upper > n_lower",
}

#: Policies by version: the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "v0": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting"],
}


HELPERS = ("_w", "_s", "_lines", "_at", "_low", "_bits")


def mask(names: list[str]) -> int:
    places = list(RULES)
    return sum(1 << places.index(n) for n in names)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES to docs.

    n_repeat_words: words inside three-word windows that occur twice or more in the text. Windows are
    packed as hash and position into one long, with only as many position bits as the text needs, and
    sorted; windows with an equal neighbour are compared word by word.
    """
    # own columns with a helper's name go through under another
    away = {c: unused(f"own{c}", docs.columns) for c in docs.columns if c.lower() in HELPERS}
    docs, text = docs.withColumnsRenamed(away), away.get(text, text)
    body = F.coalesce(F.col(text), F.lit(""))
    count_of = lambda chars: F.char_length(body) - F.char_length(F.translate(body, chars, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    one = (
        docs.drop(*MEASURES)
        .withColumn("_w", words(F.col(text)))
        .withColumn("_lines", lines)
        .withColumn("word_chars", F.char_length(F.translate(body, WORD_SPACE, "")).cast("long"))
        .withColumn("n_symbols", count_of(SYMBOLS).cast("long"))
        .withColumn("n_upper", count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"))
        .withColumn("n_lower", count_of("abcdefghijklmnopqrstuvwxyz").cast("long"))
    )
    two = (
        one.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_bits", F.length(F.bin("n_words")).cast("int"))
        .drop("_lines")
    )
    at = lambda i: F.get("_w", i)
    packed = F.transform(
        F.slice("_w", 1, F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))),
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, at(i + 1), at(i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")),
    )
    three = (
        two.withColumn("_low", (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1))
        .withColumn("_s", F.sort_array(packed))
    )

    def same(x: Column, y: Column) -> Column:
        p, q = (v.bitwiseAND(F.col("_low")).cast("int") for v in (x, y))
        return (
            (F.call_function("shiftright", x, F.col("_bits")) == F.call_function("shiftright", y, F.col("_bits")))
            & (at(p) == at(q)) & (at(p + 1) == at(q + 1)) & (at(p + 2) == at(q + 2))
        )

    twice = F.filter("_s", lambda x, i: F.coalesce(same(x, F.get("_s", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_s", i + 1)), F.lit(False)))
    four = three.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("_low")))))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", i + 1) - p, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    # the row number, always true here, keeps the optimizer from copying the measures into filters above them
    covered = F.when(F.monotonically_increasing_id() >= 0, covered)
    return four.withColumn("n_repeat_words", covered).drop("_w", "_bits", "_low", "_s", "_at").withColumnsRenamed({to: c for c, to in away.items()})


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES and `failed`, a long with one bit for each failed rule."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text).withColumn("failed", total.cast("long"))


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(marked: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents failing it, documents failing it alone (kept without the rule)."""
    cut = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])))
    counts = marked.agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.count_if(cut.bitwiseAND(F.lit(mask([n]))) != 0).alias(f"hit_{n}") for n in POLICIES[policy]],
        *[F.count_if(cut == mask([n])).alias(f"only_{n}") for n in POLICIES[policy]],
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"hit_{n}").alias("n_failed"), F.col(f"only_{n}").alias("n_only")) for n in POLICIES[policy]])
    return counts.select(F.explode(rows).alias("r"), "n_docs").select("r.rule", "r.n_failed", "r.n_only", "n_docs")


def quality_filter(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return ledger(own.withColumn("text", F.col("_row.text"))).filter(passes(policy)).select("_row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(mask(POLICIES["v0"]))) != 0).alias("base_failed"),
        passes("v1").alias("kept"), "failed", "n_lines", "n_upper", "n_lower",
    )


OP9_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, list_filter(string_split_regex(t, '[ \t\n\v\f\r]+'), lambda x: x <> '') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) as l from d),
g as (select rid, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
k as (select rid, i, count(*) over (partition by rid, w[i], w[i+1], w[i+2]) as c from g),
c as (select rid, i + o as p from k, (values (0), (1), (2)) v(o) where c >= 2 group by all),
r as (select rid, count(*) as n from c group by rid),
m as (select d.rid, doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[ \t\n\v\f\r]', '', 'g'))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
        (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_upper,
        (length(t) - length(regexp_replace(t, '[a-z]', '', 'g')))::bigint as n_lower
      from d join w using (rid) left join r using (rid)),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
        + case when 20 * n_symbols > word_chars then 4 else 0 end + case when 10 * n_dup_lines > 5 * n_lines then 8 else 0 end
        + case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 30 * n_words) then 16 else 0 end
        + case when n_upper > n_lower then 32 else 0 end)::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed,
       failed = 0 as kept, failed, n_lines, n_upper, n_lower from f
"""
