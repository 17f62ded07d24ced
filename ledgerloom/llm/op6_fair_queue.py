"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow served in proportion to its target. Its documents are shuffled by a hash; a
document's virtual finish time is the flow's words up to and with it, divided by the flow's target.
A small source repeats, up to `MAX_PASSES` times. Entries are sorted by finish time over all sources
and served until the budget of words is spent; at that moment, virtual time 1, the document in service
in each flow has been served in part, so every source gets its target to the word (rounding aside).

Sums inside a hot source run over 4,096 hash ranges and the global order over 4,096 ranges of
virtual time, which every flow fills evenly; only range totals meet in one place.

Cases: a null text has no words and takes part with size 0 (taken 0); null is a source of its own,
the last; a source without words has target 0; repeated rows are separate entries; ties in the
shuffle fall to doc_id, size and text hash, so only equal rows can swap; a very long text is one
document of many words and may be served in part; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, table

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int], passes: int) -> DataFrame:
    """(source, source_size, target, words): the target by water filling, one row per source."""
    flows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    flows = flows.select("source", "source_size", place.alias("place"), weight.cast("long").alias("weight"))
    fullest = [(F.col("source_size") / F.col("weight")), F.col("place")]
    before = Window.orderBy(*fullest).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*fullest).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * passes
    spread = F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    flows = flows.withColumn("level", spread / F.sum("weight").over(after)).withColumn("capped", cap <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy(F.lit(0)))
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * level)
    return flows.select("source", "source_size", "place", target.alias("target"), F.round(target).cast("long").alias("words"))


def _upto(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Add `name`, the sum of `value` before the row; the last of `keys` is an ordered range of the others' order."""
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__t"))
    # the constant keeps the window of one global order (at most RANGES rows) a keyed one
    across = Window.partitionBy(*keys[:-1], F.lit(0)).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__b"))
    same = [df[k].eqNullSafe(base[f"__{k}"]) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    local = df.withColumn("__l", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(base, on).withColumn(name, F.col("__l") + F.col("__b")).drop("__l", "__b", *[f"__{k}" for k in keys])


def served_entries(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MAX_PASSES, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """All rows with their sizes and targets, and the entries (row_id, epoch, finish, position, words) served within the budget."""
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = cut_lineage(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            shuffle.alias("h"),
            F.xxhash64("text").alias("tie"),
        )
    )
    targets = cut_lineage(source_targets(rows, weights, passes))
    flow = _upto(rows.filter("size > 0").withColumn("range", F.substring("h", 1, 3)), ["source", "range"], [F.col("h"), F.col("doc_id"), F.col("size"), F.col("tie")], "size", "before")
    named = targets.withColumnRenamed("source", "__s")
    flow = flow.join(named, flow["source"].eqNullSafe(named["__s"])).drop("__s")
    entry = flow.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("from", F.col("epoch") * F.col("source_size") + F.col("before"))
    entry = entry.withColumn("words", F.least("size", F.col("words") - F.col("from"))).filter("words > 0")
    entry = entry.withColumn("finish", F.least(F.lit(1.0), (F.col("from") + F.col("size")) / F.col("target")))
    entry = cut_lineage(
        entry.select("row_id", "epoch", "finish", "words", "place", "h", "doc_id", "size", "tie", F.least(F.lit(RANGES - 1), F.floor(F.col("finish") * RANGES)).cast("int").alias("slot"))
    )
    budget = rows.agg(F.sum("size")).first()[0] or 0
    order = [F.col(c) for c in ("finish", "place", "epoch", "h", "doc_id", "size", "tie")]
    queued = _upto(entry, ["slot"], order, "words", "position")
    queued = queued.withColumn("words", F.least("words", F.lit(budget) - F.col("position"))).filter("words > 0")
    return rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"]), queued.select("row_id", "epoch", "finish", "position", "words")


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """(row_id, doc_id, source, size, source_size, target, taken, first_finish) of every row."""
    rows, served = served_entries(docs, weights, passes)
    taken = served.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("finish").alias("first_finish"))
    return rows.join(taken, "row_id", "left").select("row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_finish")


def mixed_order(docs: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """The mixture as a training run reads it: (row_id, doc_id, epoch, finish, position, words), range-sorted by position."""
    rows, served = served_entries(docs, weights, passes)
    return served.join(rows.select("row_id", "doc_id"), "row_id").repartitionByRange("position").sortWithinPartitions("position")


def op6_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1]::BIGINT AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
  / (sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
g AS (SELECT source, source_size, place, CASE WHEN 3 * source_size <= weight * level THEN (3 * source_size)::DOUBLE
  ELSE weight * max(level) FILTER (WHERE NOT 3 * source_size <= weight * level) OVER () END AS target FROM l),
f AS (SELECT d.doc_id, d.size, d.h, g.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, epoch * source_size + before AS start FROM f, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0),
q AS (SELECT doc_id, place, epoch, h, size, least(size, round(target)::BIGINT - start) AS words, least(1.0::DOUBLE, (start + size) / target) AS finish FROM e WHERE round(target)::BIGINT > start),
p AS (SELECT doc_id, least(words, (SELECT sum(size) FROM d)::BIGINT - coalesce(sum(words) OVER (ORDER BY finish, place, epoch, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS words FROM q),
t AS (SELECT doc_id, sum(words) AS taken FROM p WHERE words > 0 GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(t.taken, 0)::BIGINT AS taken FROM f LEFT JOIN t USING (doc_id)
"""
