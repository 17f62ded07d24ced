"""Ordered scans that survive one group holding a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole group to one task.
These scans split every group of more than `CHUNK_ROWS` ordinals into order-consistent
chunks, run the window inside each chunk, scan the much smaller table of chunk totals, and
add the carried value back.  Where no group is that long, which one look at keys and
ordinals tells, that plain window is used: chained scans over one key then share one
shuffle, and nothing is written.

`chunk` is a list of columns that is a prefix of the order (or a block of it), so
chunk order equals row order.  `block_of` builds one from a dense ordinal, `spread_of`
one from an ordinal with gaps, whose width per key follows from its range and count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.session import cut_lineage

CHUNK_ROWS = 1 << 18


@dataclass(frozen=True)
class Scan:
    """One running value. kind: sum, last, min, plus prev_* for values before the row."""

    kind: str
    value: Column


@dataclass(frozen=True)
class Block:
    """A chunk column of a dense ordinal; see `block_of`."""

    ordinal: str | Column
    size: int = CHUNK_ROWS

    def number(self) -> Column:
        col = F.col(self.ordinal) if isinstance(self.ordinal, str) else self.ordinal
        # cut towards zero, so ordinals counted backwards from 0 begin in chunk 0 as well
        return (col / F.lit(self.size)).cast("bigint")


def block_of(ordinal: str | Column, size: int = CHUNK_ROWS) -> Block:
    """Order-consistent chunks of a dense ordinal, counted forward or backward from 0."""
    return Block(ordinal, size)


@dataclass(frozen=True)
class Spread:
    """A chunk column still to be made from an ordinal with gaps; see `spread_of`."""

    ordinal: str
    size: int = CHUNK_ROWS


def spread_of(ordinal: str, size: int = CHUNK_ROWS) -> Spread:
    """Order-consistent chunks of about `size` rows of a numeric ordinal with gaps, by key."""
    return Spread(ordinal, size)


def _spread(df: DataFrame, keys: Sequence[str], spread: Spread, name: str) -> DataFrame:
    """Add the chunk number of a spread ordinal: equal slices of each key's range, as many as its rows ask for."""
    value = F.col(spread.ordinal)
    stats = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("__n"))
    # rows with a null key find no range and form one chunk
    joined = df.join(stats, list(keys), "left")
    width = F.greatest(F.ceil((F.col("__hi") - F.col("__lo") + 1) / F.ceil(F.col("__n") / spread.size)), F.lit(1))
    chunk = F.coalesce(F.floor((value - F.col("__lo")) / width), F.lit(-1)).cast("bigint")
    return joined.withColumn(name, chunk).drop("__lo", "__hi", "__n")


def fits(df: DataFrame, keys: Sequence[str], chunk: Sequence[Column | Block | Spread] | None) -> bool:
    """Whether every group is a single chunk, so that a plain window holds few rows of it."""
    if chunk is None:
        return True
    if len(chunk) != 1 or isinstance(chunk[0], Column):
        return False
    only = chunk[0]
    if isinstance(only, Spread):
        long = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > only.size)
    else:
        long = df.filter(only.number() != 0).select(F.lit(1))
    return long.isEmpty()


def _local(spec: Scan, value: Column, base) -> Column:
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    return {
        "sum": lambda: F.sum(value).over(upto),
        "prev_sum": lambda: F.sum(value).over(before),
        "last": lambda: F.last(value, ignorenulls=True).over(upto),
        "prev_last": lambda: F.last(value, ignorenulls=True).over(before),
        "min": lambda: F.min(value).over(upto),
        "prev_min": lambda: F.min(value).over(before),
    }[spec.kind]()


def _merged(spec: Scan, mine: Column, before: Column | None) -> Column:
    """A chunk's own value with what is carried into it; the type is the same with nothing carried."""
    kind = spec.kind.removeprefix("prev_")
    if kind == "sum":
        return F.coalesce(mine, F.lit(0)) + (F.lit(0) if before is None else F.coalesce(before, F.lit(0)))
    if before is None:
        return mine
    return F.least(mine, before) if kind == "min" else F.coalesce(mine, before)


def _total(spec: Scan, value: Column, order: Column) -> Column:
    kind = spec.kind.removeprefix("prev_")
    if kind == "sum":
        return F.sum(value)
    if kind == "min":
        return F.min(value)
    return F.max_by(value, F.when(value.isNotNull(), order))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Sequence[Column | Block | Spread] | None,
    specs: dict[str, Scan],
    written: bool = False,
    near: bool = False,
) -> DataFrame:
    """Add one column per spec: a running value over (keys ORDER BY order).

    `order` must be unique inside a key and hold no nulls. With ``chunk=None`` the
    caller vouches that groups are small and a plain window is used; `written` says
    that `df` is read from a table and need not be written again, `near` that its keys and
    ordinals are rows or windows over one, so it is written only if some group is long.
    """
    keys = list(keys)
    values = {name: F.col(f"__v_{name}") for name in specs}
    work = df.select("*", *[s.value.alias(f"__v_{n}") for n, s in specs.items()])
    drop = [f"__v_{n}" for n in specs]
    if chunk is not None and not (written or near):
        work = cut_lineage(work)
    if fits(work, keys, chunk):
        base = Window.partitionBy(*keys).orderBy(*order)
        out = work.withColumns({name: _merged(s, _local(s, values[name], base), None) for name, s in specs.items()})
        return out.drop(*drop)

    if near:
        work = cut_lineage(work)
    ck = [f"__c{i}" for i in range(len(chunk))]
    for n, c in zip(ck, chunk, strict=True):
        if isinstance(c, Spread):
            work = _spread(work, keys, c, n)
        else:
            work = work.withColumn(n, c.number() if isinstance(c, Block) else c)
    base = Window.partitionBy(*keys, *ck).orderBy(*order)
    local = work
    for name, spec in specs.items():
        local = local.withColumn(f"__l_{name}", _local(spec, values[name], base))

    row_order = F.struct(*order)
    totals = work.groupBy(*keys, *ck).agg(
        *[_total(s, values[n], row_order).alias(f"__t_{n}") for n, s in specs.items()]
    )
    across = Window.partitionBy(*keys).orderBy(*ck).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        *ck,
        *[
            {
                "sum": F.sum(f"__t_{n}").over(across),
                "min": F.min(f"__t_{n}").over(across),
                "last": F.last(f"__t_{n}", ignorenulls=True).over(across),
            }[s.kind.removeprefix("prev_")].alias(f"__b_{n}")
            for n, s in specs.items()
        ],
    )
    out = local.join(carried, [*keys, *ck], "left")
    for name, spec in specs.items():
        out = out.withColumn(name, _merged(spec, F.col(f"__l_{name}"), F.col(f"__b_{name}")))
    return out.drop(*drop, *ck, *[f"__l_{n}" for n in specs], *[f"__b_{n}" for n in specs])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Sequence[Column | Block | Spread] | None, name: str, written: bool = False, near: bool = False
) -> DataFrame:
    """`row_number()` over (keys ORDER BY order) on split groups."""
    out = scan(df, keys, order, chunk, {name: Scan("sum", F.lit(1))}, written, near)
    return out.withColumn(name, F.col(name).cast("bigint"))


def first_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], last: bool = False
) -> DataFrame:
    """Keep one row per key by aggregation, so hot keys combine before the shuffle."""
    cols = df.columns
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*cols), F.struct(*order)).alias("__row")
    names = [f"__k{i}" for i in range(len(keys))]
    grouped = [
        (F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)
    ]
    return df.groupBy(*grouped).agg(row).select("__row.*")
