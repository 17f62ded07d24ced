"""Connected components by random contraction, all state in written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of `edges` (u, v): nodes have equal comp exactly if a path joins them.

    Each round every node moves to the node of its closed neighbourhood that comes first in an order
    drawn anew per round, so a constant share of the nodes vanishes whatever the shape (a long chain
    too), and the edges are rewritten to what is left. The moves are then followed backwards. Each
    aggregate combines before its shuffle; the rounds grow with the logarithm of the largest component.
    """
    moves = []
    live = cut_lineage(edges.filter("u != v").select("u", "v"))
    while live.head(1):
        order = F.xxhash64(F.lit(len(moves)), "b")
        both = live.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(live.select(F.col("v").alias("a"), F.col("u").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(order.alias("o"), "b")).alias("near"))
        own = F.struct(F.xxhash64(F.lit(len(moves)), "a").alias("o"), F.col("a").alias("b"))
        move = cut_lineage(nearest.select(F.col("a").alias("node"), F.least("near", own)["b"].alias("to")))
        moves.append(move)
        left = move.select(F.col("node").alias("u"), F.col("to").alias("p"))
        right = move.select(F.col("node").alias("v"), F.col("to").alias("q"))
        kept = live.join(left, "u").join(right, "v").filter("p != q")
        live = cut_lineage(kept.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
    if not moves:
        return live.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return reduce(
        lambda label, move: move.join(label.select(F.col("node").alias("to"), "comp"), "to", "left").select("node", F.coalesce("comp", "to").alias("comp")),
        reversed(moves[:-1]),
        moves[-1].select("node", F.col("to").alias("comp")),
    )
