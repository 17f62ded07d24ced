"""Money text to DECIMAL(18,2). Nothing here goes through floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import _c, let

MONEY = "decimal(18,2)"


def money_parse(x: str | Column) -> Column:
    """`$1,234.56`, leading or trailing minus; anything else is null."""
    s = F.regexp_replace(_c(x), r"[$,\s]", "")
    # In text that reads as money a minus stands in front or at the end.
    sign = F.when(_c(x).contains("-"), "-").otherwise("")
    value = let(s, lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)-?\z"), F.translate(t, "+-", "")))
    return F.concat(sign, value).try_cast(MONEY)


def worksheet_money(x: str | Column) -> Column:
    """Worksheet cell: a lone dash is zero, a minus sign survives."""
    return let(_c(x), lambda t: F.when(F.trim(t).isin("-", "–", "—"), F.lit(0).cast(MONEY)).otherwise(money_parse(t)))


def loose_money(x: str | Column) -> Column:
    """Keep digits, point and sign only, then parse."""
    return money_parse(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[^0-9.+-]", ""))


def money_text(x: Column) -> Column:
    """Two decimals, empty read as 0.00."""
    return F.coalesce(x.cast(MONEY), F.lit(0).cast(MONEY)).cast("string")
