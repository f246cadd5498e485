"""Columns that normalise the fields of log lines. Bad values become null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitscope.functions.ip import let
from hitscope.functions.request import upper

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _of_millis(ms: Column) -> Column:
    """A time without zone, in UTC."""
    return F.when(F.abs(ms) < 2**53, F.timestamp_add("MILLISECOND", ms.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


def iso_time(x: Column) -> Column:
    """An ISO 8601 time to UTC, cut to milliseconds; without an offset it is taken as UTC."""
    plain = F.when(x.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?[Zz]?\z"), F.translate(x, "TZz", " ").try_cast("timestamp_ntz"))
    return F.coalesce(F.date_trunc("millisecond", plain).cast("timestamp_ntz"), let(x, _any_iso_time))


def _any_iso_time(x: Column) -> Column:
    zone = F.regexp_extract(x, r"(Z|z|[+-]\d{2}:?\d{2})\z", 1)
    body = F.regexp_replace(F.regexp_replace(x, r"(Z|z|[+-]\d{2}:?\d{2})\z", ""), "T", " ")
    body = F.when(body.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), body).when(body.rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}(:\d{2}([.,]\d+)?)?\z"), F.replace(body, F.lit(","), F.lit(".")))
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(digits == "", 0).otherwise(sign * (digits.substr(1, 2).try_cast("int") * 60 + digits.substr(3, 2).try_cast("int")))
    local = body.try_cast("timestamp_ntz")
    return F.date_trunc("millisecond", F.timestamp_add("MINUTE", -minutes, local)).cast("timestamp_ntz")


def event_time(x: Column) -> Column:
    """Epoch seconds, milliseconds or nanoseconds (told apart by size) or an ISO time.

    Digit strings of 16 characters or more are nanoseconds, so that 16-digit microseconds are misread; this is kept.
    """

    def read(s: Column) -> Column:
        number = s.try_cast("double")
        size = F.abs(number)
        digits = F.char_length(F.regexp_extract(s, r"\A[+-]?(\d+)\z", 1))
        ms = (
            F.when(digits >= 16, F.floor(s.try_cast("decimal(30,0)") / 1_000_000).cast("double")).when(size >= 1e15, F.floor(number / 1e6)).when(size >= 1e12, F.floor(number)).otherwise(F.floor(number * 1000 + 1e-6))
        )
        return F.when(s.rlike(r"\A[+-]?\d+(\.\d+)?([eE][+-]?\d+)?\z"), _of_millis(ms)).otherwise(iso_time(s))

    return let(F.trim(x), read)


def clf_time(x: Column) -> Column:
    """dd/Mon/yyyy:HH:MM:SS ±hhmm to UTC; month names must have their usual case, and days must exist."""
    part = lambda first, size: x.substr(first, size)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(4, 3))
    local = F.concat(part(8, 4), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), part(1, 2), F.lit(" "), part(13, 8)).try_cast("timestamp_ntz")
    minutes = part(23, 2).try_cast("int") * 60 + part(25, 2).try_cast("int")
    shape = x.rlike(r"\A\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}\z")
    return F.when(shape & (month > 0), F.timestamp_add("MINUTE", F.when(part(22, 1) == "-", minutes).otherwise(-minutes), local))


def method(x: Column) -> Column:
    return let(upper(F.trim(x)), lambda m: F.when(m.rlike(r"\A[!#$%&'*+.^_`|~0-9A-Z-]+\z"), m))


def path(x: Column) -> Column:
    """A path with its query; an absolute URL gives its own; null if empty or with white space."""

    def own(url: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://[^/?#]*", ""), "#.*$", "")
        return let(rest, lambda r: F.when(r == "", "/").when(F.startswith(r, F.lit("?")), F.concat(F.lit("/"), r)).otherwise(r))

    return let(F.trim(x), lambda t: F.when((t != "") & ~t.rlike(r"\s"), F.when(t.rlike(r"(?i)^https?://"), own(t)).otherwise(t)))


def status(x: Column) -> Column:
    s = F.when(F.trim(x).rlike(r"\A\d{3}\z"), F.trim(x).try_cast("int"))
    return F.when(s.between(100, 999), s)


def size(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t == "-", F.lit(0).cast("bigint")).when(t.rlike(r"\A\d{1,16}(\.0+)?\z"), F.floor(t.try_cast("double")).cast("bigint"))


def text(x: Column) -> Column:
    """'-' and null are ''."""
    return F.coalesce(F.when(x != "-", x), F.lit(""))


def millis(x: Column) -> Column:
    v = F.trim(x).try_cast("double")
    return F.when(v >= 0, F.round(v, 3))


def seconds_to_millis(x: Column) -> Column:
    v = F.trim(x).try_cast("double")
    return F.when(v >= 0, F.round(v * 1000, 3))
