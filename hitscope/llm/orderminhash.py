"""Order MinHash fingerprints, sensitive to edit distance, from built-in expressions only.

A text's k-mers are runs of K words (shorter at its end). Equal k-mers are numbered by occurrence, so that repeats
count. Each numbered k-mer hashes into one of BINS bins; of each bin the TUPLE smallest are selected, put back into
text order and hashed together into the bin's slot. Texts that share k-mers but in another order thus differ.
Likeness is the share of bins, of those filled in either text, whose slots are equal.

How it is computed: hash and position are packed into one long and sorted, so that equal k-mers stand together
(their rank in such a run, found by pointer jumping, is the occurrence number) and, after hashing numbers in, so
do bins. One pass each; no array is searched for each of its elements.

Defined cases: a null text is empty; an empty text has no slot and the fingerprint ''; two such are wholly alike;
repeated rows have equal fingerprints; extra columns named like the output are replaced, others stay as they are. A
position has as many bits as an array has places, so that texts of every length are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitscope.llm.common import documents, materialize, unused, words

K, TUPLE, BINS_LOG2, SLOT_BITS = 3, 2, 6, 24
POSITION_BITS = 31
#: Rounds of pointer jumping; each multiplies the run length that is resolved by JUMPS.
JUMPS, ROUNDS = 8, 11
SEGMENTS, ROWS_A_BUCKET = 256, 20_000


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BINS_LOG2)


def with_slots(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the slots of a text: array<int>, bin number and tuple hash in one."""
    own = [c for c in df.columns if c != out]
    w, s, n, run, g, top = (unused(c, df.columns) for c in ("_w", "_s", "_n", "_run", "_g", "_top"))
    low = (1 << POSITION_BITS) - 1
    at = lambda i: F.get(w, i)
    one = df.withColumn(w, words(F.col(text)))
    two = one.withColumn(
        s, F.sort_array(F.transform(w, lambda x, i: F.shiftleft(F.xxhash64(x, *[at(i + j) for j in range(1, K)]), POSITION_BITS).bitwiseOR(i.cast("long")))),
    )
    hashed = lambda x: F.shiftright(x, POSITION_BITS)
    repeats = lambda x, i: hashed(x) == hashed(F.get(s, i - 1))
    now = two.withColumn(n, F.size(F.filter(s, repeats)))
    now = now.withColumn(run, F.when(F.col(n) > 0, F.transform(s, lambda x, i: F.when(repeats(x, i), i - 1).otherwise(i))))
    for r in range(ROUNDS):
        def jump(v: Column) -> Column:
            for _ in range(JUMPS - 1):
                v = F.get(run, v)
            return v

        now = now.withColumn(run, F.when(F.col(n) > JUMPS**r - 1, F.transform(run, jump)).otherwise(F.col(run)))
    renumbered = F.transform(
        s,
        lambda x, i: F.when(
            F.get(run, i) == i, x
        ).otherwise(F.shiftleft(F.xxhash64(hashed(x), i - F.get(run, i)), POSITION_BITS).bitwiseOR(x.bitwiseAND(F.lit(low)))),
    )
    now = now.withColumn(g, F.when(F.col(n) > 0, F.sort_array(renumbered)).otherwise(F.col(s)))
    now = now.withColumn(top, F.filter(g, lambda x, i: F.coalesce(_bin(x) != _bin(F.get(g, i - TUPLE)), F.lit(True))))

    def slot(x: Column, i: Column) -> Column:
        members = [F.when(_bin(F.get(top, i + j)) == _bin(x), F.get(top, i + j)) for j in range(TUPLE)]
        by_place = F.array_sort(F.array(*[F.struct(m.bitwiseAND(F.lit(low)).alias("p"), hashed(m).alias("h")) for m in members]))
        tuple_hash = F.xxhash64(*[F.get(by_place, F.lit(j))["h"] for j in range(TUPLE)])
        value = F.shiftleft(_bin(x), SLOT_BITS).bitwiseOR(F.shiftrightunsigned(tuple_hash, 64 - SLOT_BITS)).cast("int")
        return F.when(F.coalesce(_bin(x) != _bin(F.get(top, i - 1)), F.lit(True)), value)

    now = now.withColumn(out, F.array_compact(F.transform(top, slot)))
    return now.select(*[F.col(f"`{c}`") for c in own], out)


def written(slots: Column) -> Column:
    """A fingerprint as text: eight hex digits for each filled bin."""
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, SLOT_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def descending_bucket(docs: DataFrame, key: str) -> Column:
    """An int that never falls as the key falls (nulls last), with about equally many rows to each value.

    Quantiles of the key (their number is fixed) bound segments; for large tables each is divided evenly.
    """
    n = docs.count()
    cuts = docs.approxQuantile(key, [i / SEGMENTS for i in range(SEGMENTS + 1)], 0.0005) if n else []
    bounds = sorted({int(c) for c in cuts})
    within = max(1, n // (SEGMENTS * ROWS_A_BUCKET))
    k = F.col(key).cast("long")

    def leaf(i: int) -> Column:
        """Segment i holds keys from bounds[i - 1] on and below bounds[i]."""
        first = (len(bounds) - i) * within
        if within == 1 or not 0 < i < len(bounds):
            return F.lit(first)
        part = ((k - F.lit(bounds[i - 1])).cast("double") * within / float(bounds[i] - bounds[i - 1])).cast("int")
        return F.lit(first + within - 1) - F.least(F.greatest(part, F.lit(0)), F.lit(within - 1))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(k < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(k.isNull(), F.lit((len(bounds) + 1) * within)).otherwise(tree(0, len(bounds)))


def with_next(docs: DataFrame, key: str, carried: list[str], bucket: Column, firsts: DataFrame) -> DataFrame:
    """docs with next_<c> for each carried column: the value in the next row by falling key, after the last the first.

    firsts: (_bucket, and the carried columns) of the first row of each bucket. The one window over all buckets holds
    their numbers only; values are joined to it.
    """
    order = W.partitionBy("_bucket").orderBy(F.col(key).desc_nulls_last(), F.xxhash64("text").desc())
    every = W.partitionBy().orderBy("_bucket")
    value = F.struct(*carried)
    lead = F.coalesce(F.lead("_bucket").over(every), F.first("_bucket").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    after = firsts.select("_bucket").withColumn("_after", lead)
    follow = after.join(firsts.select(F.col("_bucket").alias("_after"), value.alias("_follow")), "_after").drop("_after")
    found = docs.withColumn("_bucket", bucket).withColumn("_lead", F.lead(value).over(order)).join(follow, "_bucket")
    taken = F.coalesce("_lead", "_follow")
    return found.select("*", *[taken[c].alias(f"next_{c}") for c in carried]).drop("_bucket", "_lead", "_follow")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket = descending_bucket(docs, "doc_id")
    heads = docs.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.max_by("text", F.struct(F.col("doc_id"), F.xxhash64("text"))).alias("text"))
    firsts = materialize(with_slots(heads, "text", "slots"), "omh-firsts")
    paired = with_next(with_slots(docs, "text", "slots"), "doc_id", ["text", "slots"], bucket, firsts)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), "slots", "next_slots",
        F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)).alias("edited"),
    )
    both = with_slots(edited, "edited", "edited_slots")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("slots")).alias("fingerprint"),
        written(F.col("edited_slots")).alias("edited_fingerprint"), likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )
