"""Similarity joins that never compare all pairs.

Candidates come from an index of bigrams.  When two texts must share at least T of their
bigrams in order, the rarest shared one is among the rarest (n - T + 1) of either side, at
places that differ by no more than the characters that stay unmatched, in texts of like
length; gram and length band are the join key, the places a condition on it.  Pairs that
meet are then counted: all T grams must be there, and the edit distance must leave room for
the matched characters.  The token-set score adds an index of
words weighted by their characters, counted the same way.  Scores run in Arrow UDFs over
what is left.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.session import cut_lineage

#: Text lengths are banded in steps of a quarter.
LENGTH_STEP = 1.25


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity; argument order matters for long texts."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    seats: dict[str, int] = {}
    for i, ch in enumerate(a):
        seats[ch] = seats.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & seats.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _closeness(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common_length(a, b) / total


def _token_set(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_a or not only_b):
        return 100.0
    full_a, full_b = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    best = _closeness(full_a, full_b)
    if shared:
        best = max(best, _closeness(shared, full_a), _closeness(shared, full_b))
    return best


@F.pandas_udf(T.DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """0..100: shared words against each side's leftovers."""
    return pd.Series([_token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _numbered(tokens: Column) -> Column:
    """Tag repeats with their occurrence number so multisets behave as sets."""
    return F.transform(
        tokens,
        lambda t, i: F.concat(t, F.lit("\x01"), F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda u: u == t)).cast("string")),
    )


def _bigrams(text: Column) -> Column:
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))
    singles = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("\x02"), F.substr(text, i, F.lit(1))))
    # Up to three characters a match may share no pair, so single characters join in.
    return F.when(n <= 3, F.concat(F.filter(pairs, lambda p: F.length(p) == 2), singles)).otherwise(pairs)


def _share(n: Column, ratio: float) -> Column:
    """Bigrams that texts of `n` characters together share at least.

    With M matched characters in k blocks, k <= n - 2M + 1, so at least M - k bigrams are
    shared; M >= ratio * n / 2.
    """
    return F.ceil((1.5 * ratio - 1.0) * n - 1.0 - 1e-9)


def _band(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(LENGTH_STEP))).cast("int")


def _indexed(df: DataFrame, text: str, ratio: float, ordered: bool) -> DataFrame:
    """(text, n, grams, bag): the bigrams in order, and hashes of them with repeats numbered."""
    grams = _bigrams(F.col(text))
    numbered = _numbered(grams)
    return df.select(text, F.length(text).alias("n"), (grams if ordered else numbered).alias("grams"), F.transform(numbered, lambda t: F.xxhash64(t)).alias("bag"))


def _prefix(rows: DataFrame, text: str, counts: DataFrame, ratio: float) -> DataFrame:
    """(text, n, token, pos) for the rarest bigrams that a match cannot all miss."""
    n = F.col("n")
    # the ratio also forces the lengths' sum to 2n / (2 - ratio) or more
    share = _share(n * (2.0 / (2.0 - ratio)), ratio)
    keep = F.when(n <= 3, F.lit(1 << 20)).otherwise(F.greatest((n - 1) - F.greatest(share, F.lit(1)) + 1, F.lit(1)))
    tokens = rows.select(text, "n", keep.cast("int").alias("keep"), F.posexplode("grams").alias("pos", "token"))
    ranked = tokens.join(counts, "token").groupBy(text, "n", "keep").agg(
        F.array_sort(F.collect_list(F.struct("freq", "token", "pos"))).alias("tokens")
    )
    return ranked.select(text, "n", F.explode(F.slice("tokens", F.lit(1), F.col("keep"))).alias("t")).select(text, "n", "t.token", "t.pos")


def ratio_candidates(left: DataFrame, right: DataFrame, a: str, b: str, ratio: float, ordered: bool = True) -> DataFrame:
    """Distinct (a, b) pairs that can reach 2*matched/(len a + len b) >= ratio.

    `ordered` says that the texts are matched as they stand; otherwise only their bigrams count,
    not where they are.
    """
    left, right = (cut_lineage(_indexed(x.select(c).distinct(), c, ratio, ordered)) for x, c in ((left, a), (right, b)))
    both = left.select(F.explode("grams").alias("token")).unionByName(right.select(F.explode("grams").alias("token")))
    counts = cut_lineage(both.groupBy("token").agg(F.count("*").alias("freq")))
    wide = (2.0 - ratio) / ratio
    bands = F.explode(F.sequence(_band(F.floor(F.col("n") / wide)), _band(F.ceil(F.col("n") * wide))))
    x = _prefix(left, a, counts, ratio).withColumn("band", bands).withColumnsRenamed({"n": "na", "pos": "pa"})
    y = _prefix(right, b, counts, ratio).withColumn("band", _band(F.col("n"))).withColumnsRenamed({"n": "nb", "pos": "pb"})
    total, matched = F.col("na") + F.col("nb"), F.ceil((F.col("na") + F.col("nb")) * ratio / 2 - 1e-9)
    shift = F.col("pb") - F.col("pa")
    near = (F.least("na", "nb") <= 3) | ((shift <= F.col("nb") - matched) & (-shift <= F.col("na") - matched))
    alike = 2 * F.least("na", "nb") >= F.lit(ratio) * total - 1e-9
    pairs = x.join(y, ["token", "band"]).filter(alike & near if ordered else alike).select(a, b).distinct()
    bags = pairs.join(left.select(a, F.col("n").alias("na"), F.col("bag").alias("xa")), a).join(right.select(b, F.col("n").alias("nb"), F.col("bag").alias("xb")), b)
    enough = (F.least("na", "nb") <= 3) | (F.size(F.array_intersect("xa", "xb")) >= _share(F.col("na") + F.col("nb"), ratio))
    if ordered:
        # what is matched in order need not be edited: the distance is at most the unmatched characters of both
        spare = F.floor((1.0 - ratio) * (F.col("na") + F.col("nb")) + 1e-9).cast("int")
        enough = enough & (F.call_function("levenshtein", F.col(a), F.col(b), spare) >= 0)
    return bags.filter(enough).select(a, b)


def token_set_candidates(left: DataFrame, right: DataFrame, a: str, b: str, score: float) -> DataFrame:
    """Distinct (a, b) pairs that can reach the token-set score.

    Either the whole texts are close, or one side keeps nearly all of its characters in
    shared words, so one of that side's rarest words is shared.
    """
    r = score / 100.0
    left, right = cut_lineage(_worded(left, a)), cut_lineage(_worded(right, b))
    # Padded with blanks, the bigrams of a word list do not depend on word order.
    padded = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    la, rb = left.withColumn("__sa", padded(F.col("ws"))).select(a, "__sa"), right.withColumn("__sb", padded(F.col("ws"))).select(b, "__sb")
    close = ratio_candidates(la, rb, "__sa", "__sb", r, ordered=False).join(la, "__sa").join(rb, "__sb").select(a, b)
    wa, wb = (x.select(c, "ws", F.explode("ws").alias("word")) for x, c in ((left, a), (right, b)))
    freq = cut_lineage(wa.select("word").unionByName(wb.select("word")).groupBy("word").agg(F.count("*").alias("freq")))

    def rare(w: DataFrame, key: str) -> DataFrame:
        """The rarest words of a side that can keep so little of itself unshared, one more than it may miss."""
        listed = w.join(freq, "word").groupBy(key, "ws").agg(F.array_sort(F.collect_list(F.struct("freq", "word"))).alias("by"))
        size = F.length(F.array_join("ws", " "))
        # the shared words make r / (2 - r) of the side's characters, so more than the rest holds one of them
        spare = size * (2.0 - 2.0 * r) / (2.0 - r) + 1e-9
        weight = lambda ws: F.aggregate(ws, F.lit(0), lambda s, x: s + F.length(x["word"]) + 1)
        picked = F.filter("by", lambda x, i: weight(F.slice("by", F.lit(1), i)) <= spare)
        return listed.select(key, "ws", F.explode(picked).alias("x")).select(key, "ws", F.col("x.word").alias("word"))

    def held(mine: str, other: str) -> Column:
        """Whether the shared words make enough of `mine`."""
        shared, size = F.length(F.array_join(F.array_intersect(mine, other), " ")), F.length(F.array_join(mine, " "))
        return 2.0 * shared >= r * (shared + size) - 1e-9

    named = lambda w, c, n: w.select(c, F.col("ws").alias(n), "word")
    by_a = named(rare(wa, a), a, "xa").join(named(wb, b, "xb"), "word").filter(held("xa", "xb")).select(a, b)
    by_b = named(wa, a, "xa").join(named(rare(wb, b), b, "xb"), "word").filter(held("xb", "xa")).select(a, b)
    return close.unionByName(by_a).unionByName(by_b).distinct()


def _worded(df: DataFrame, text: str) -> DataFrame:
    """Distinct texts with their distinct words in order."""
    ws = F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")))
    return df.select(text).distinct().withColumn("ws", ws)
