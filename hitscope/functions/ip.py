"""IP addresses as fixed-width hex text, whose order is the numeric order: 8 digits for IPv4, 32 for IPv6."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"\A(?:{_BYTE}\.){{3}}{_BYTE}\z"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def v4_key(ip: Column) -> Column:
    """8 hex digits, or null."""
    digits = F.array_join(F.transform(F.split(ip, r"\."), lambda b: F.lpad(F.lower(F.hex(b.try_cast("int"))), 2, "0")), "")
    return F.when(ip.rlike(_V4), digits)


def _pad(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def v6_key(ip: Column, embedded: bool = True) -> Column:
    """32 hex digits, or null; embedded: whether a dotted IPv4 tail is allowed."""

    def plain(s: Column) -> Column:
        """The address with a dotted tail written as two groups."""
        tail = F.regexp_extract(s, r"([0-9]+(?:\.[0-9]+){3})\z", 1)
        return let(v4_key(tail), lambda four: F.when(
            four.isNotNull(), F.concat(F.regexp_replace(s, r"[0-9.]+\z", ""), four.substr(1, 4), F.lit(":"), four.substr(5, 4))
        ).otherwise(s))

    def key(s: Column) -> Column:
        short = F.contains(s, F.lit("::"))
        groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
        left = F.when(short, groups(F.substring_index(s, "::", 1))).otherwise(F.split(s, ":"))
        right = F.when(short, groups(F.substring_index(s, "::", -1))).otherwise(F.array().cast("array<string>"))

        def joined(p: Column) -> Column:
            n = F.size(p["l"]) + F.size(p["r"])
            fine = F.forall(F.concat(p["l"], p["r"]), lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")) & F.when(short, n <= 7).otherwise(n == 8)
            return F.when(fine, F.concat(_pad(p["l"]), F.repeat(F.lit("0000"), F.greatest(F.lit(8) - n, F.lit(0))), _pad(p["r"])))

        shape = s.rlike(r"\A[0-9a-f:]+\z") & ~s.rlike(r":::|::.*::|\A:[^:]|[^:]:\z")
        return F.when(shape, let(F.struct(left.alias("l"), right.alias("r")), joined))

    low = F.lower(ip)
    return let(let(low, plain) if embedded else low, key)


def ip_key(ip: Column, mapped: bool = True) -> Column:
    """The key of an address of either family, or null. mapped: ::ffff:a.b.c.d counts as a.b.c.d; else it has no key."""

    def narrowed(six: Column) -> Column:
        return F.when(F.startswith(six, F.lit("0" * 20 + "ffff")), six.substr(25, 8) if mapped else F.lit(None).cast("string")).otherwise(six)

    return F.coalesce(v4_key(ip), F.when(F.contains(ip, F.lit(":")), let(v6_key(ip, embedded=mapped), narrowed)))


def cidr_range(cidr: Column) -> Column:
    """struct<first, last>: the keys of a block's ends, or of a single address; null where it is neither."""

    def ends(key: Column) -> Column:
        width = F.char_length(key) * 4
        given = F.when(F.contains(cidr, F.lit("/")), F.regexp_extract(cidr, r"/([0-9]{1,3})\z", 1).try_cast("int")).otherwise(width)
        return let(F.when((given >= 0) & (given <= width), given), lambda bits: block(key, bits))

    def block(key: Column, bits: Column) -> Column:
        full, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
        digit = F.conv(key.substr(full + 1, F.lit(1)), 16, 10).cast("int")
        step = F.call_function("shiftleft", F.lit(1), 4 - rest)
        low = digit - digit % step
        n = F.greatest(F.char_length(key) - full - 1, F.lit(0))
        head = key.substr(F.lit(1), full)
        edge = lambda d, fill: F.when(full == F.char_length(key), key).otherwise(F.concat(head, F.lower(F.hex(d)), F.repeat(F.lit(fill), n)))
        return F.when(bits.isNotNull() & key.isNotNull(), F.struct(edge(low, "0").alias("first"), edge(low + step - 1, "f").alias("last")))

    return let(ip_key(F.substring_index(cidr, "/", 1)), ends)


def after(key: Column) -> Column:
    """The next key; null after the last."""

    def next_of(ones: Column) -> Column:
        digit = F.conv(key.substr(F.char_length(key) - ones, F.lit(1)), 16, 10).cast("int") + 1
        carried = F.concat(key.substr(F.lit(1), F.char_length(key) - ones - 1), F.lower(F.hex(digit)), F.repeat(F.lit("0"), ones))
        return F.when(ones < F.char_length(key), carried)

    return let(F.char_length(F.regexp_extract(key, r"(f*)\z", 1)), next_of)
