"""Address ranges: merging, and finding the range of an address.

Ranges and addresses are keys of hitscope.functions.ip. The lookup never compares every address with every range:
a range stands under the blocks it touches, of the smallest of a few sizes of which it touches FEW at most; an address
looks under its one block of each size, and only those are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitscope.functions.ip import after, cidr_range

#: Hex digits that blocks share, by the length of a key: /16 and /8 for IPv4; /48, /32 and /16 for IPv6.
BLOCK_DIGITS = {8: (4, 2), 32: (12, 8, 4)}
FEW = 256


def from_cidrs(df: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Adds first and last, the keys of a block's ends; rows that are no block are dropped."""
    return df.withColumn("_r", cidr_range(F.col(cidr))).filter("_r is not null").withColumn("first", F.col("_r.first")).withColumn("last", F.col("_r.last")).drop("_r")


def merged(ranges: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, last): overlapping and adjacent ranges of a family joined."""
    family = F.char_length("first")
    order = W.partitionBy(*by, "_f").orderBy("first", "last")
    reached = ranges.withColumn("_f", family).withColumn("_reach", F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)))
    new = F.col("_reach").isNull() | (F.col("first") > F.coalesce(after(F.col("_reach")), F.col("_reach")))
    marked = reached.withColumn("_new", new.cast("int"))
    numbered = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_f", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_f", "_g")


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def _blocks(first: Column, last: Column) -> Column:
    def of(size: int, digits: tuple[int, ...]) -> Column:
        def block(n: int) -> Column:
            between = F.sequence(_number(first.substr(1, n)), _number(last.substr(1, n)))
            return F.transform(between, lambda b: F.concat_ws(":", F.lit(f"{size}-{n}"), F.lpad(F.lower(F.hex(b)), n, "0")))

        few = lambda n: _number(last.substr(1, n)) - _number(first.substr(1, n)) < FEW
        *small, widest = digits
        return reduce(lambda wider, n: F.when(few(n), block(n)).otherwise(wider), reversed(small), block(widest))

    return F.coalesce(*[F.when((F.char_length(first) == size) & (first <= last), of(size, digits)) for size, digits in BLOCK_DIGITS.items()])


def _own_blocks(key: Column) -> Column:
    return F.coalesce(*[
        F.when(F.char_length(key) == size, F.array(*[F.concat_ws(":", F.lit(f"{size}-{n}"), key.substr(1, n)) for n in digits])) for size, digits in BLOCK_DIGITS.items()
    ])


def matches(keys: DataFrame, ranges: DataFrame, key: str, on: list[str] | None = None) -> DataFrame:
    """Distinct (on, key) joined to every range, of equal `on`, that holds the key."""
    on = on or []
    probes = keys.select(*on, key).distinct().filter(F.col(key).isNotNull()).withColumn("_block", F.explode(_own_blocks(F.col(key))))
    held = ranges.withColumn("_block", F.explode(_blocks(F.col("first"), F.col("last"))))
    return probes.join(held, [*on, "_block"]).filter((F.col("first") <= F.col(key)) & (F.col(key) <= F.col("last"))).drop("_block")


def latest(keys: DataFrame, ranges: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields) of the range that starts last at or before the key, if it holds the key; other keys are left out.

    A range is thus cut short where the next one starts, even by one that ends before it. Of ranges with one start,
    the last by end and fields counts. One window over the ranges of a family finds each one's successor; there are
    as many ranges as a routing table has, whatever the number of keys.
    """
    order = W.partitionBy(F.char_length("first")).orderBy("first", "last", *fields)
    cut = ranges.select("first", "last", *fields).withColumn("_next", F.lead("first").over(order)).filter("_next is null or first < _next")
    return matches(keys, cut, key).filter(F.col("_next").isNull() | (F.col(key) < F.col("_next"))).select(key, *fields)
