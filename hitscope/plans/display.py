"""How panels are shown: short numbers, ages, shares, the chart's default selection, and the periods on offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Periods on offer: hours of the overview, days of the page panels. Fixed values.
HOURS, DAYS = (24, 24 * 7, 24 * 30), (7, 30, 90)
#: Pages in a chart at most.
MOST_SELECTED = 10


def short_number(value: Column) -> Column:
    """1234567 as 1.2M, 12345 as 12K, 1234 as 1.2K, smaller numbers as they are."""
    tenths = lambda x: F.format_string("%.1f", x.cast("double"))
    return (
        F.when(value >= 1_000_000, F.concat(tenths(value / 1_000_000), F.lit("M")))
        .when(value >= 10_000, F.concat(F.floor(value / 1000 + 0.5).cast("string"), F.lit("K")))
        .when(value >= 1000, F.concat(tenths(value / 1000), F.lit("K"))).otherwise(value.cast("string"))
    )


def age(ts: Column, now: Column) -> Column:
    """now, 5m ago, 3h ago, 2d ago; times to come are now."""
    minutes = F.floor(F.greatest(F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")), F.lit(0)) / 60_000_000)
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    hours = F.floor(minutes / 60)
    return F.when(minutes < 1, "now").when(minutes < 60, told(minutes, "m")).when(hours < 24, told(hours, "h")).otherwise(told(F.floor(hours / 24), "d"))


def default_pages(pages_daily: DataFrame, most: int = MOST_SELECTED) -> list[str]:
    """The pages a chart starts with: the most popular ones, of a panel that holds a few dozen at most."""
    top = pages_daily.groupBy("page").agg(F.sum("hits").alias("total")).orderBy(F.desc("total"), "page").limit(most)
    return [r["page"] for r in top.collect()]


def toggled(selected: list[str], page: str, most: int = MOST_SELECTED) -> list[str]:
    """The selection without the page if it was there, with it if there is room."""
    if page in selected:
        return [p for p in selected if p != page]
    return [*selected, page] if len(selected) < most else selected


def series(pages_daily: DataFrame, selected: list[str]) -> DataFrame:
    """(page, dates, hits) of the selected pages, most popular first."""
    rows = pages_daily.filter(F.col("page").isin(selected)).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("date", "hits"))).alias("d"), F.sum("hits").alias("total"))
    return rows.orderBy(F.desc("total"), "page").select("page", F.col("d.date").alias("dates"), F.col("d.hits").alias("hits"))
