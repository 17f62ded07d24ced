"""Timecards and payroll sheets: hours blocks, punches, section payroll.

Input everywhere is (doc_id, pos, text) lines; the employee a line belongs to is carried
down by a chunked scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY, money_parse
from ledgerloom.functions.payroll_text import (
    has_words_only,
    is_payroll_furniture,
    one_spaced,
    payroll_detail,
    payroll_numbers,
    payroll_phrases,
    payroll_rate,
    payroll_section,
)
from ledgerloom.plans.ordered import CHUNK_ROWS, Scan, Spread, fits, number_rows, scan, spread_of

NUMERIC_LINE = r"^\d+(?:\.\d{2})?$"
DATE_LINE = r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"
TIME_LINE = r"(?i)^\d{1,2}:\d{2}\s?(?:AM|PM)$"
EMPLOYEE_HEADER = r"^\[(.*?)\] (.+)"
BIG_NUMBER = r"^\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?$"
DETAIL_WORDS = r"\$|보너스|빌려간돈|빼고"


def carry_forward(lines: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = ("doc_id",), order: str = "pos") -> DataFrame:
    """Carry each column's last non-null value down the lines of a document."""
    return scan(lines, list(keys), [order], [spread_of(order)], {n: Scan("last", v) for n, v in values.items()}, near=True)


def _split(lines: DataFrame, order: str) -> list[Spread] | None:
    """How scans inside the blocks of these documents are cut: not at all where whole documents are short."""
    return None if fits(lines, ["doc_id"], [spread_of("pos")]) else [spread_of(order)]


def employee_lines(lines: DataFrame) -> DataFrame:
    """Timecard lines with their employee and block number; lines before the first header drop out."""
    name = F.nullif(F.regexp_extract("text", EMPLOYEE_HEADER, 2), F.lit(""))
    head = F.when(name.isNotNull(), F.struct(F.col("pos").alias("block"), F.trim(name).alias("employee")))
    out = carry_forward(lines, {"__h": head}).filter(F.col("__h").isNotNull() & (F.col("__h.block") < F.col("pos")))
    return out.select("doc_id", "pos", "text", F.col("__h.block").alias("block"), F.col("__h.employee").alias("employee"))


def hours_summary(lines: DataFrame) -> DataFrame:
    """REG, OVER, DOUBLE, TOTAL from the last six numbers of each employee block, and their check."""
    nums = employee_lines(lines).filter(F.col("text").rlike(NUMERIC_LINE))
    back = nums.withColumn("__back", -F.col("pos"))
    ranked = number_rows(back, ["doc_id", "block", "employee"], ["__back"], _split(lines, "__back"), "rn").filter("rn <= 6")
    at = lambda i: F.max(F.when(F.col("rn") == i, F.col("text").cast(MONEY)))
    out = ranked.groupBy("doc_id", "block", "employee").agg(
        F.count("*").alias("__n"), at(4).alias("reg"), at(3).alias("over"), at(2).alias("double"), at(1).alias("total")
    )
    gap = F.abs(F.col("reg") + F.col("over") + F.col("double") - F.col("total"))
    return out.filter("__n = 6").drop("__n").withColumn("valid_sum", gap < F.lit("0.01").cast(MONEY))


def punch_stamps(lines: DataFrame) -> DataFrame:
    """(doc_id, block, employee, ts): a date line directly followed by a time line."""
    rows = scan(
        employee_lines(lines), ["doc_id", "block"], ["pos"], _split(lines, "pos"), {"__p": Scan("prev_last", F.struct("pos", "text"))}
    )
    pair = rows.filter(F.col("text").rlike(TIME_LINE) & F.col("__p.text").rlike(DATE_LINE) & (F.col("__p.pos") == F.col("pos") - 1))
    d = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    part = lambda i: F.regexp_extract("__p.text", d, i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    clock = F.upper(F.regexp_replace("text", r"\s", ""))
    stamp = F.concat_ws(" ", F.concat_ws("-", year, F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), F.lpad(clock, 7, "0"))
    return pair.select("doc_id", "block", "employee", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd hh:mma")).alias("ts")).filter(F.col("ts").isNotNull())


def pair_punches(punches: DataFrame, keys: tuple[str, ...] = ("employee",), tie: str | None = None) -> DataFrame:
    """Shifts per person and day: stamps in order pair 1-2, 3-4, ...; a dangling last one drops."""
    day = punches.withColumn("day", F.to_date("ts"))
    order = ["ts", tie] if tie else ["ts"]
    ranked = number_rows(day, [*keys, "day"], order, [F.date_trunc("hour", "ts")], "rn")
    pairs = ranked.groupBy(*keys, "day", F.floor((F.col("rn") - 1) / 2).alias("shift")).agg(
        F.count("*").alias("__n"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    seconds = F.col("end").cast("timestamp").cast("long") - F.col("start").cast("timestamp").cast("long")
    return pairs.filter("__n = 2").withColumn("seconds", seconds).filter("seconds > 0").drop("__n")


def split_shift_days(shifts: DataFrame, keys: tuple[str, ...] = ("employee",)) -> DataFrame:
    """Days with at least two shifts of half an hour or more."""
    days = shifts.groupBy(*keys, "day").agg(F.count_if(F.col("seconds") >= 1800).alias("__n"))
    return days.groupBy(*keys).agg(F.count_if(F.col("__n") >= 2).alias("split_days"))


def threshold_days(lines: DataFrame, hours: float) -> DataFrame:
    """Days whose printed total reaches `hours`: first four numbers of a run where the fourth is largest."""
    rows = employee_lines(lines)
    number = F.when(F.col("text").rlike(NUMERIC_LINE), F.col("text").cast(MONEY))
    run = scan(
        rows.withColumn("v", number), ["doc_id", "block", "employee"], ["pos"], _split(lines, "pos"),
        {"run": Scan("sum", F.when(F.col("v").isNull(), 1).otherwise(0))},
    )
    # A window looks three lines ahead; slices of a long run also hold the three lines after them.
    here, first = F.floor(F.col("pos") / CHUNK_ROWS), F.floor((F.col("pos") - 3) / CHUNK_ROWS)
    numbers = run.filter(F.col("v").isNotNull()).withColumn("__slice", F.explode(F.when(first < here, F.array(here, first)).otherwise(F.array(here))))
    slices = Window.partitionBy("doc_id", "block", "employee", "run", "__slice").orderBy("pos")
    fours = numbers.withColumns({f"v{i}": F.max("v").over(slices.rangeBetween(i, i)) for i in range(4)})
    fours = fours.filter(F.col("__slice") == here).withColumn("start", F.col("pos"))
    full = F.col("v0").isNotNull() & F.col("v1").isNotNull() & F.col("v2").isNotNull() & F.col("v3").isNotNull()
    good = fours.filter(full & (F.col("v3") >= F.greatest("v0", "v1", "v2")))
    days = good.groupBy("doc_id", "block", "employee", "run").agg(F.min_by("v3", "start").alias("day_total"))
    return days.groupBy("doc_id", "block", "employee").agg(F.count_if(F.col("day_total") >= F.lit(hours).cast(MONEY)).alias("days"))


def payroll_lines(lines: DataFrame) -> DataFrame:
    """Sheet lines with employee and section; a new name clears the section."""
    clean = lines.filter(~is_payroll_furniture(F.col("text"))).withColumn("text", one_spaced(F.col("text")))
    # A line of words is a section or else a name; each is read once, before the scan.
    worded = clean.withColumn("__words", F.when(has_words_only(F.col("text")), F.col("text")))
    marked = worded.withColumn("__section", payroll_section(F.col("__words")))
    marks = {
        "name": Scan("last", F.when(F.col("__section").isNull(), F.col("__words"))),
        # Blank at a name line, which waits for a salary or a section.
        "section": Scan("last", F.when(F.col("__words").isNotNull(), F.coalesce("__section", F.lit("")))),
    }
    flagged = marked.withColumn("is_mark", F.col("__words").isNotNull())
    out = scan(flagged, ["doc_id"], ["pos"], _split(lines, "pos"), marks, near=True).drop("__words", "__section")
    return out.withColumns({"waiting": F.col("section") == "", "section": F.nullif("section", F.lit(""))})


def payroll_by_section(lines: DataFrame) -> DataFrame:
    """Totals per (doc, name, section), with the first non-zero rate and the last salary and memo."""
    text, kind, rate, numbers = (F.col(c) for c in ("text", "kind", "rate", "numbers"))
    said = F.when(F.col("is_mark"), "mark").when(F.col("waiting") & text.rlike(BIG_NUMBER), "salary").when(text.contains("보고"), "memo")
    staged = payroll_lines(lines).filter(F.col("name").isNotNull()).select("doc_id", "name", "section", "pos", "text", said.alias("kind"))
    # Step by step, so that what later columns name several times is a column and not computed again.
    staged = staged.withColumn("detail", kind.isNull() & F.col("section").isNotNull())
    staged = staged.withColumn("rate", F.when(F.col("detail"), payroll_rate(text)))
    staged = staged.withColumn("numbers", F.when(rate.isNotNull(), payroll_numbers(text)))
    fields = payroll_detail(text, rate, numbers) | payroll_phrases(text)
    detail = F.when(rate.isNotNull() | (F.col("detail") & text.rlike(DETAIL_WORDS)), F.struct(*[v.alias(k) for k, v in fields.items()]))
    rows = staged.select(
        "doc_id", "name", "section", "pos", kind, detail.alias("d"),
        F.when(kind == "salary", money_parse("text")).alias("salary"), F.when(kind == "memo", text).alias("memo"),
    )
    zero = F.lit(0).cast(MONEY)
    paid = F.when(F.col("d.rate") > 0, F.col("pos"))
    sums = {c: F.col(f"d.{c}") for c in ("reg", "over", "double", "tip", "bonus", "sick")} | {"advance": F.col("d.advance") + F.col("d.extra_advance")}
    # A memo is part of the key at first: texts in the aggregates would have all rows sorted for them.
    parts = rows.groupBy("doc_id", "name", "section", "memo").agg(
        F.min_by("d.rate", paid).alias("rate"), F.min(paid).alias("rate_at"),
        *[F.sum(v).alias(c) for c, v in sums.items()],
        F.max_by("salary", F.when(kind == "salary", F.col("pos"))).alias("salary"),
        F.max(F.when(kind == "salary", F.col("pos"))).alias("salary_at"),
        F.max(F.when(kind == "memo", F.col("pos"))).alias("memo_at"),
    )
    latest = lambda c: F.max(F.when(F.col(f"{c}_at").isNotNull(), F.struct(f"{c}_at", c)))
    out = parts.groupBy("doc_id", "name", "section").agg(
        F.min_by("rate", "rate_at").alias("rate"), *[F.sum(c).alias(c) for c in sums], latest("salary").alias("salary"), latest("memo").alias("memo")
    )
    # Salary and memo belong to the name, whatever the section; lines of no document belong to none.
    person = Window.partitionBy("doc_id", "name")
    note = lambda c: F.when(F.col("doc_id").isNotNull(), F.max(c).over(person)[c])
    noted = out.withColumns({"salary": note("salary"), "memo": note("memo")}).filter(F.col("section").isNotNull())
    return noted.select(
        "doc_id", "name", "section", F.coalesce("rate", zero).alias("rate"),
        *[F.coalesce(F.col(c), zero).cast(MONEY).alias(c) for c in ("reg", "over", "double", "tip", "advance", "bonus", "sick")],
        F.coalesce("salary", zero).alias("salary"), F.coalesce("memo", F.lit("")).alias("memo"),
    )


def payroll_totals(agg: DataFrame) -> DataFrame:
    """Pay columns: rate times hours, overtime at 1.5, double time at 2, sick hours."""
    pay = lambda h, k: (F.col("rate") * F.col(h) * F.lit(k).cast("decimal(3,1)")).cast("decimal(18,4)")
    return agg.withColumns(
        {"hourly_total": pay("reg", "1"), "over_total": pay("over", "1.5"), "double_total": pay("double", "2"), "sick_total": pay("sick", "1")}
    )
