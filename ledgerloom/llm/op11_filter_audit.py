"""Audit of how filters interact, by exact constrained least squares over all coalitions.

Every document gets a bit per filter that it fails. Removing with a set S of filters (a coalition)
takes v(S) documents, those that fail at least one of S; per part the 32 values of v are tabulated
for all documents, for the good and for the toxic ones. What a filter takes as step k of an order is
the difference of two coalitions, and so are the documents that fail it alone.

Shapley values solve a weighted least squares problem: the additive game closest to v, coalitions
of size s weighing (m - 1) / (C(m, s) s (m - s)), with the values summing to v(all) - v(none). The
normal equations have the same matrix for every part, so they are solved once, in rationals, for
the 32 unit games; a part's values are that solution applied to its own v. Summed over all m!
orders they are whole numbers. Nothing but the table of (part, bits) is ever gathered: m! m rows a part.

Equal texts meet in one aggregate by text hash; what follows sees a row per (text, part, label), so
a text that a third of the table shares is combined before it is shuffled.

Cases: null and empty texts are one text, without words; a null lang is part '', as is an empty one;
rows of equal doc_id are never smaller than each other, and a null doc_id is neither smaller nor
larger than any, so such rows never fail E, nor do they carry labels; a doc_id with several labels
counts as good or toxic if any of them says so; repeated rows count each; very long texts are split
into words in memory, one text at a time; other columns are not read; an empty table gives no part
and no row.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import UPPER, cut_lineage, table

NAMES = "ABCDE"
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of matrix @ X = right by elimination in rationals."""
    n = len(matrix)
    rows = [a + b for a, b in zip(matrix, right, strict=True)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[n:] for row in rows]


def shapley_weights(m: int) -> list[list[int]]:
    """weights[i][S], so that the sum of weights[i][S] v(S) is filter i's removals over all m! orders.

    Least squares over the coalitions but for the empty and the full one, with a multiplier for the
    sum of the values, all right-hand sides at once: column S stands for the game that is 1 at S alone.
    """
    every = range(1 << m)
    inner = [s for s in every if 0 < s.bit_count() < m]
    weight = {s: Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in inner}
    inside = lambda s, *members: all(s >> i & 1 for i in members)
    normal = [[sum((weight[s] for s in inner if inside(s, i, j)), Fraction(0)) for j in range(m)] + [Fraction(1)] for i in range(m)]
    normal.append([Fraction(1)] * m + [Fraction(0)])
    # values are measured from the empty coalition
    right = [[(weight.get(s, Fraction(0)) if inside(s, i) else Fraction(0)) for s in every] for i in range(m)]
    for row, i in zip(right, range(m), strict=True):
        row[0] = -sum((weight[s] for s in inner if inside(s, i)), Fraction(0))
    right.append([Fraction(int(s == (1 << m) - 1) - int(s == 0)) for s in every])
    whole = [[x * factorial(m) for x in row] for row in solve(normal, right)[:m]]
    assert all(x.denominator == 1 for row in whole for x in row)
    return [[int(x) for x in row] for row in whole]


def failed_bits(text: Column) -> Column:
    """Bits 0 to 3 of a text: too few words, too few distinct ones, too many capitals, symbols."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    length = F.char_length(text)
    capitals = length - F.char_length(F.translate(text, UPPER, ""))
    rules = (n < MIN_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals * 100 > length * MOST_CAPITALS, text.rlike(SYMBOLS))
    return sum((F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, docs, good, toxic): how many documents fail exactly the filters in `bits`."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), failed_bits(text).alias("bits"))
    rows = rows.groupBy("doc_id", "h", "part", "bits").agg(F.count("*").alias("c"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id"), F.lit(b"").alias("__spread")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without a doc_id find no label; their text hash deals them over the tasks of the join
    spread = F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(F.lit(b""))
    rows = rows.withColumn("__at", spread).join(marks, (F.col("doc_id") == F.col("__id")) & (F.col("__at") == F.col("__spread")), "left")
    rows = rows.select("doc_id", "h", "part", "bits", "c", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    kinds = rows.groupBy("h", "part", "bits", "good", "toxic").agg(F.sum("c").alias("n"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("c")).otherwise(0)).alias("unnamed"))
    # the rows of one doc_id may lie in several kinds, so the smallest id of a text is taken over its kinds
    kinds = cut_lineage(kinds)
    first = kinds.groupBy("h").agg(F.min("least").alias("first"))
    kinds = kinds.join(first, "h")
    whole = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    alone = kinds.select("part", "bits", "good", "toxic", whole.alias("n"))
    copies = kinds.select("part", F.col("bits").bitwiseOR(F.lit(16)).alias("bits"), "good", "toxic", (F.col("n") - whole).alias("n"))
    both = alone.unionAll(copies).groupBy("part", "bits")
    return both.agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def coalitions(counts: DataFrame, m: int) -> DataFrame:
    """(part, game): per part the array of (docs, good, toxic) removed by every coalition from 0 to 2^m - 1, then the total."""
    measures = ("docs", "good", "toxic")
    met = F.col("bits").bitwiseAND(F.col("s")) != 0
    every = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))))
    sums = every.groupBy("part", "s").agg(*[F.coalesce(F.sum(F.when(met, F.col(c))), F.lit(0)).cast("long").alias(c) for c in measures], F.sum("docs").cast("long").alias("total"))
    return sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", *measures, "total"))).alias("game"))


def audit(games: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters (a letter each) and step, from the coalition table."""
    m = len(names)
    every = (1 << m) - 1
    at = lambda s, c="docs": F.col("game")[s][c]
    values = F.array(*[sum((at(s) * w for s, w in enumerate(row) if w), F.lit(0)).cast("long") for row in shapley_weights(m)])
    only = F.array(*[at(every) - at(every ^ 1 << i) for i in range(m)])
    rows = games.select("part", "game", values.alias("values"), only.alias("only"))
    rows = rows.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(names)])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(m))))
    place = lambda k: F.instr(F.lit(names), F.substring("filter_order", k, 1)) - 1
    bit = lambda k: F.pow(F.lit(2), place(k)).cast("int")
    rows = rows.withColumn("i", sum((F.when(F.col("step") == k, place(k)).otherwise(0) for k in range(1, m + 1)), F.lit(0)))
    rows = rows.withColumn("b", sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, m + 1)), F.lit(0)))
    rows = rows.withColumn("single", F.pow(F.lit(2), F.col("i")).cast("int")).withColumn("a", F.col("b") + F.col("single"))
    taken = lambda c: at(F.col("a"), c) - at(F.col("b"), c)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (at(0, "total") - at(F.col("a"))).alias("kept"),
        taken("docs").alias("removed"),
        (at(F.col("single")) - taken("docs")).alias("redundant"),
        F.col("only")[F.col("i")].alias("unique_fails"),
        taken("good").alias("good_lost"),
        taken("toxic").alias("toxic_lost"),
        F.col("values")[F.col("i")].alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(cut_lineage(coalitions(counts, len(NAMES))), NAMES)


ORACLE = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
d AS (SELECT part, len(words) < 100 AS "A", 100 * len(list_distinct(words)) < 80 * len(words) AS "B", 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS "C",
  regexp_matches(text, '[#$%&*|]') AS "D", coalesce(doc_id > first, false) AS "E", coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, (CASE WHEN "A" THEN 'A' ELSE '' END) || (CASE WHEN "B" THEN 'B' ELSE '' END) || (CASE WHEN "C" THEN 'C' ELSE '' END) || (CASE WHEN "D" THEN 'D' ELSE '' END) || (CASE WHEN "E" THEN 'E' ELSE '' END) AS fails,
  count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step, x, coalesce(n, 0) AS n, good, toxic, contains(fails, x) AS hit, fails = x AS alone,
  earlier <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN 'x' ELSE earlier END || ']') AS gone FROM s, c),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r
"""
