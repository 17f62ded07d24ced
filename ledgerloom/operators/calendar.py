"""US business days: the calendar table and shifts on it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days of a calendar that is small enough to broadcast (about 500 years, 8 MB).
BROADCAST_DAYS = 200_000


@dataclass(frozen=True)
class Span:
    """First and last day of some data, and the most business days that any of it moves."""

    first: dt.date
    last: dt.date
    reach: int = 0


def span_of(df: DataFrame, day: str, steps: str | None = None) -> Span:
    """The span of a frame's days and moves, by one aggregate; a frame without days has an empty one."""
    far = F.max(F.abs(F.coalesce(F.col(steps), F.lit(0)))) if steps else F.lit(0)
    low, high, reach = df.agg(F.min(day), F.max(day), far).first()
    if low is None:
        return Span(dt.date(1970, 1, 1), dt.date(1970, 1, 1))
    return Span(low, high, int(reach or 0))


def is_holiday(d: Column) -> Column:
    """One of eleven federal holidays. A fixed date on a weekend is not moved."""
    month, day, wd = F.month(d), F.dayofmonth(d), F.weekday(d)
    fixed = lambda m, k: (month == m) & (day == k)
    nth = lambda m, w, n: (month == m) & (wd == w) & (F.ceil(day / 7) == n)
    return (
        fixed(1, 1) | fixed(6, 19) | fixed(7, 4) | fixed(11, 11) | fixed(12, 25)
        | nth(1, 0, 3) | nth(2, 0, 3) | ((month == 5) & (wd == 0) & (day > 24))
        | nth(9, 0, 1) | nth(10, 0, 2) | nth(11, 3, 4)
    )


def is_business_day(d: Column) -> Column:
    return (F.weekday(d) < 5) & ~is_holiday(d)


def business_calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """(day, idx, bd): every day, the running number of its last business day, and that day.

    One row per day of [start, end], so the size is known before it is used.
    """
    days = F.sequence(F.lit(start), F.lit(end))
    open_days = F.filter(days, is_business_day)
    one = spark.range(1).select(open_days.alias("bds"))
    numbered = one.select(F.posexplode("bds").alias("idx", "bd"), "bds")
    nxt = F.coalesce(F.try_element_at("bds", F.col("idx") + 2), F.date_add(F.lit(end), 1))
    return numbered.select(
        F.explode(F.sequence("bd", F.date_sub(nxt, 1))).alias("day"), F.col("idx").cast("int").alias("idx"), "bd"
    )


def _calendar_for(spark: SparkSession, span: Span) -> DataFrame:
    """Calendar that holds every move of the span: 5 days of 7 are open but for 11 holidays a year."""
    wide = dt.timedelta(days=span.reach * 3 // 2 + 30)
    first = span.first - min(wide, span.first - dt.date.min)
    last = span.last + min(wide, dt.date.max - span.last)
    days = business_calendar(spark, first, last)
    return F.broadcast(days) if (last - first).days <= BROADCAST_DAYS else days


def roll_back(df: DataFrame, day: str, out: str, span: Span | None = None) -> DataFrame:
    """Add the business day on or before `day`. The span is taken from the data unless the caller knows it."""
    cal = _calendar_for(df.sparkSession, span or span_of(df, day)).select(F.col("day").alias(day), F.col("bd").alias(out))
    return df.join(cal, day, "left")


def shift_business_days(df: DataFrame, day: str, n: str | int, out: str, span: Span | None = None) -> DataFrame:
    """Move `day` by n business days either way; n = 0 leaves it where it is."""
    if isinstance(n, int):
        df = df.withColumn("__n", F.lit(n))
        return shift_business_days(df, day, "__n", out, span).drop("__n")
    cal = _calendar_for(df.sparkSession, span or span_of(df, day, n))
    steps = F.col(n)
    at = cal.select(F.col("day").alias(day), F.col("idx").alias("__i"), F.col("bd").alias("__bd"))
    # Backward from a closed day, its last business day is already the first step.
    back = F.col("__i") + steps + F.when((steps < 0) & (F.col("__bd") < F.col(day)), 1).otherwise(0)
    to = cal.filter(F.col("day") == F.col("bd")).select(F.col("idx").alias("__to"), F.col("bd").alias("__out"))
    moved = df.join(at, day, "left").withColumn("__to", back).join(to, "__to", "left")
    return moved.withColumn(out, F.when(steps == 0, F.col(day)).otherwise(F.col("__out"))).drop("__i", "__bd", "__to", "__out")


def display_date(df: DataFrame, day: str, lead: str, out: str, span: Span | None = None) -> DataFrame:
    """Roll `day` back to a business day, then `lead` business days earlier. Two calendar lookups."""
    cal = _calendar_for(df.sparkSession, span or span_of(df, day, lead))
    at = cal.select(F.col("day").alias(day), F.col("idx").alias("__i"))
    to = cal.filter(F.col("day") == F.col("bd")).select(F.col("idx").alias("__to"), F.col("bd").alias(out))
    ahead = F.greatest(F.coalesce(F.col(lead), F.lit(0)), F.lit(0))
    return df.join(at, day, "left").withColumn("__to", F.col("__i") - ahead).join(to, "__to", "left").drop("__i", "__to")
