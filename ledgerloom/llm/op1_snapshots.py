"""Chat formatting after cumulative-snapshot collapse.

Services log a conversation again after every turn, so most logged conversations are prefixes of longer
ones. A rolling hash over a conversation's turns (two sums of 64-bit hashes of position, role and
text) names each prefix; a conversation whose whole hash is a proper prefix of another is left out by an
anti-join, of equal ones the smallest id stays. What remains is rendered turn by turn.

Hashes are cumulated over ranges of 256 turn numbers, so a conversation may hold any share of the rows;
prefixes are made distinct by an aggregate before the join, so a first turn that all share is one row.
Rendered text comes in parts of `PART_TURNS` turns; a part is all that one row ever holds.

Cases: rows without conv_id belong to no conversation and are left out; a repeated row counts once; a
null turn number comes last; turns of equal number are ordered by a hash of role and text; a null role is
rendered as `unknown`, a null text as empty; control marks inside a text are broken up; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, table
from ledgerloom.plans.ordered import Scan, number_rows, scan

PART_TURNS = 64
RANGE_TURNS = 256
LAST = (1 << 62) - 1


def _keyed(turns: DataFrame) -> DataFrame:
    """Turns with a number that sorts, and two hashes of what was said."""
    said = [F.col("role"), F.col("role").isNull(), F.col("text"), F.col("text").isNull()]
    return turns.filter("conv_id is not null").select(
        "conv_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(LAST)).alias("at"), F.xxhash64(*said).alias("h"), F.xxhash64(F.lit("b"), *said).alias("g"), "role", "text"
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, at, h, g, place, s, t): the place of each distinct turn and the hash of the prefix that ends there."""
    block = [F.floor(F.col("at") / RANGE_TURNS)]
    narrow = cut_lineage(_keyed(turns).drop("role", "text").distinct())
    placed = cut_lineage(number_rows(narrow, ["conv_id"], ["at", "h", "g"], block, "place"))
    tag = lambda c, n: F.xxhash64(F.lit(n), "place", c).cast("decimal(20,0)")
    return scan(placed, ["conv_id"], ["at", "h", "g"], block, {"s": Scan("sum", tag("h", 1)), "t": Scan("sum", tag("g", 2))})


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another and the first of their equals."""
    size = hashes.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    ends = hashes.join(size, "conv_id")
    whole = ends.filter("place = n_turns").groupBy("place", "s", "t").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = ends.filter("place < n_turns").select("place", "s", "t").distinct()
    return whole.join(proper, ["place", "s", "t"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")


def render(role: str, text: str) -> Column:
    clean = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit("<|im_start|>"), F.coalesce(F.col(role), F.lit("unknown")), F.lit("\n"), clean, F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, n_turns, n_copies, part, text) of every maximal conversation."""
    hashes = cut_lineage(prefix_hashes(turns))
    kept = cut_lineage(maximal(hashes))
    seats = hashes.join(kept, "conv_id").select("conv_id", "at", "h", "g", "place", "n_turns", "n_copies")
    said = _keyed(turns).join(seats, ["conv_id", "at", "h", "g"])
    once = said.groupBy("conv_id", "place", "n_turns", "n_copies").agg(F.first(F.struct("role", "text")).alias("said"))
    line = once.select("conv_id", "n_turns", "n_copies", "place", F.floor((F.col("place") - 1) / part_turns).alias("part"), F.col("said.role").alias("role"), F.col("said.text").alias("text"))
    lines = F.sort_array(F.collect_list(F.struct("place", render("role", "text").alias("line"))))
    parts = line.groupBy("conv_id", "n_turns", "n_copies", "part").agg(lines.alias("lines"))
    return parts.select("conv_id", "n_turns", "n_copies", "part", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def op1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn) AS ts FROM r GROUP BY conv_id),
proper AS (SELECT DISTINCT ts[1:k] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM c)),
m AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ts),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM proper WHERE proper.ts = m.ts)),
l AS (SELECT conv_id, len(ts)::BIGINT AS n_turns, n_copies, unnest(range(1, len(ts) + 1)) AS i, ts FROM k)
SELECT conv_id, n_turns, n_copies, ((i - 1) // 64)::BIGINT AS part,
  string_agg('<|im_start|>' || coalesce(ts[i].role, 'unknown') || chr(10) || replace(coalesce(ts[i].text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM l GROUP BY ALL
"""
