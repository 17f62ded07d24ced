"""Date text in many spellings, tax periods, and next-occurrence arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import _c, let

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_number(name: str | Column) -> Column:
    """1..12 from the first three letters of a month name, else null."""
    numbers = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS) for v in (m, i + 1)])
    return F.try_element_at(numbers, F.lower(F.substring(_c(name), 1, 3)))


def safe_date(y: Column, m: Column, d: Column) -> Column:
    """DATE or null when the parts name no real day."""
    # Each part stands here once: they are often long expressions over patterns.
    text = F.concat(
        F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0")
    )
    return text.try_cast("date")


def wide_year(y: Column, pivot: int) -> Column:
    return F.when(y >= 100, y).when(y < pivot, y + 2000).otherwise(y + 1900)


def date_parse(x: str | Column, pivot: int = 69) -> Column:
    """ISO, compact ISO, `m/d/y` with `/ - .`, and `d-Mon-y`, with 2- or 4-digit years."""
    s = F.trim(_c(x))
    us = r"^\d{1,2}[/.\-]\d{1,2}[/.\-](\d{2}|\d{4})$"
    mon = r"^\d{1,2}-[A-Za-z]{3}-(\d{2}|\d{4})$"

    def read(t: Column) -> Column:
        iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10)).try_cast("date")
        flat = F.when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
        year = lambda p: wide_year(p[2].try_cast("int"), pivot)
        american = F.when(t.rlike(us), let(F.split(F.translate(t, "/.", "--"), "-"), lambda p: safe_date(year(p), p[0], p[1])))
        named = F.when(t.rlike(mon), let(F.split(t, "-"), lambda p: safe_date(year(p), month_number(p[1]), p[0])))
        return F.coalesce(iso, flat.try_cast("date"), american, named)

    # The text is trimmed once, and its parts are only read where the pattern has told their shape.
    return let(s, read)


def quarter_start(d: str | Column) -> Column:
    return F.date_trunc("quarter", _c(d)).cast("date")


def quarter_range(year: Column, quarter: Column) -> tuple[Column, Column]:
    first = F.make_date(year, quarter * 3 - 2, F.lit(1))
    return first, F.last_day(F.add_months(first, 2))


def previous_quarter(d: str | Column) -> tuple[Column, Column]:
    """(year, quarter) before the one holding d."""
    back = F.add_months(quarter_start(d), -1)
    return F.year(back), F.quarter(back)


def clamp_day(month_first: Column, dom: Column) -> Column:
    """Day `dom` of that month, or its last day."""
    return F.date_add(month_first, F.least(dom, F.dayofmonth(F.last_day(month_first))) - 1)


def next_monthly(start: Column, dom: Column) -> Column:
    first = F.trunc(start, "month")
    here = clamp_day(first, dom)
    return F.when(here >= start, here).otherwise(clamp_day(F.add_months(first, 1), dom))


def next_semi_monthly(start: Column, d1: Column, d2: Column) -> Column:
    return F.least(next_monthly(start, d1), next_monthly(start, d2))


def next_quarterly(start: Column, months: Column, dom: Column) -> Column:
    """First listed month's day on or after `start`; an empty list means the four quarter months."""
    listed = F.when(F.size(months) > 0, months).otherwise(F.array(*[F.lit(m) for m in (1, 4, 7, 10)]))
    first = F.trunc(start, "month")
    ahead = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.add_months(first, k))
    days = F.transform(F.filter(ahead, lambda m: F.array_contains(listed, F.month(m))), lambda m: clamp_day(m, dom))
    return F.coalesce(F.array_min(F.filter(days, lambda d: d >= start)), start)
