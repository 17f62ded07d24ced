"""Monthly checklists as a long table: (section, year, company_key, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank, label_sort_key
from ledgerloom.plans.ordered import number_rows
from ledgerloom.plans.session import cut_lineage

# The grid's sixteen columns and cell states.
COLUMNS = ("Jan", "Feb", "Mar", "Q1", "Apr", "May", "Jun", "Q2", "Jul", "Aug", "Sep", "Q3", "Oct", "Nov", "Dec", "Q4")
STATES = ("To do", "Done")
KEY = ("section", "year", "company_key")


def normalize_cell(x: str | Column) -> Column:
    """Stored state of a cell: decorated legacy labels fold to plain ones, the rest is blank."""
    bare = F.trim(F.regexp_replace(blank(x), "[⏳✅]", ""))
    return F.when(bare.isin(*STATES), bare).otherwise("")


def checklist_grid(cells: DataFrame) -> DataFrame:
    """One row per company and year with sixteen columns, by a pivot over fixed values."""
    wide = cells.groupBy(*KEY).pivot("col", list(COLUMNS)).agg(F.max("value"))
    return wide.select(*KEY, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS])


def _blank_rows(companies: DataFrame) -> DataFrame:
    each = F.explode(F.array(*[F.lit(c) for c in COLUMNS]))
    return companies.select(*KEY, each.alias("col"), F.lit("").alias("value"))


def union_years(cells: DataFrame, from_year: int, to_year: int) -> DataFrame:
    """Add from_year's companies to to_year with blank cells; companies already there keep theirs."""
    src = cells.filter(F.col("year") == from_year).select("section", F.lit(to_year).alias("year"), "company_key").distinct()
    there = cells.filter(F.col("year") == to_year).select(*KEY).distinct()
    types = dict(cells.dtypes)
    fresh = _blank_rows(src.join(there, list(KEY), "left_anti")).withColumn("year", F.col("year").cast(types["year"]))
    return cells.unionByName(fresh)


def checklist_apply(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (KEY, ord, action set | add | remove, col, value).

    Per company the last add or remove decides whether it exists, and cell edits after the
    last remove decide its values; both are aggregations over the edit table.
    """
    gone = edits.groupBy(*KEY).agg(
        F.max(F.when(F.col("action") == "remove", F.col("ord"))).alias("__gone"),
        F.max(F.when(F.col("action") != "remove", F.col("ord"))).alias("__back"),
    )
    live = edits.join(gone, list(KEY)).filter(F.col("__gone").isNull() | (F.col("ord") > F.col("__gone")))
    sets = live.filter(F.col("action") == "set").groupBy(*KEY, "col").agg(F.max_by(normalize_cell("value"), "ord").alias("__v"))
    removed = gone.filter(F.col("__gone").isNotNull()).select(*KEY)
    kept = cells.join(removed, list(KEY), "left_anti")
    present = kept.select(*KEY).distinct()
    added = live.filter(F.col("action").isin("add", "set")).select(*KEY).distinct().join(present, list(KEY), "left_anti")
    base = kept.unionByName(_blank_rows(added).select(*cells.columns))
    out = base.join(sets, [*KEY, "col"], "full_outer")
    return out.select(*KEY, "col", F.coalesce("__v", "value", F.lit("")).alias("value"))


def sort_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Accent-free order with digit-led labels last."""
    key = label_sort_key(label)
    return df.orderBy(key["digits"], key["text"], label)


def label_positions(df: DataFrame, label: str = "label") -> DataFrame:
    """`df` with its place in the order of `sort_labels`, from 1; labels are distinct.

    Rows are cut into ranges of the order, numbered inside, and moved by the sizes of the ranges before.
    """
    keyed = df.withColumns({"__d": label_sort_key(label)["digits"], "__t": label_sort_key(label)["text"], "__g": F.lit(0)})
    ranged = cut_lineage(keyed.repartitionByRange("__d", "__t", label).withColumn("__part", F.spark_partition_id()))
    out = number_rows(ranged, ["__g"], ["__d", "__t", label], [F.col("__part")], "position", written=True)
    return out.select(*df.columns, "position")
