"""Near-duplicate groups by SetSketch registers.

A text is a set of shingles. Register i of its sketch is the exponentially spaced, truncated minimum
of exponential variables that the shingles draw, floor(1 - log_b(min)), so sketches merge by
maximum and equal registers are the likelier the more two sets share. Equal bands of registers make
candidates, the joint likelihood of two sketches estimates their Jaccard similarity, and every link
is confirmed by intersecting the full sets.

Texts with equal sets are one class from the start (one aggregate), so copies never pair up. Each class
that shares a band is first compared with the bucket centre it meets most often, a class whose bands
many share, and then with a few more; what that links is contracted. Then the classes of buckets that still hold different
components are compared across components, all pairs that can be links: two sets over the threshold
have their first common shingle, in any fixed order, near the front of both. Rare shingles come
first, so what sets a copy apart keeps it from meeting its whole group, and no link is lost.
The number of bands follows from the threshold, so that a pair at it shares none with a chance of
2e-8; of the pairs across components, those whose estimate lies six deviations below the threshold
are not looked at, which happens to a pair at the threshold with a chance of 1e-9. Nothing else is lost.

Cases: null and empty texts have an empty set and link with nothing; a text of fewer words than a
shingle is one shingle; rows with the same doc_id are separate rows of one id; a null doc_id takes
part, and its component is the smallest id it reaches, else null; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import bitmap_of, bits_at, cut_lineage, map_arrow, table
from ledgerloom.llm.components import components
from ledgerloom.llm.words import NOT_SPACE, byte_view, grams, mix, words

ROWS = 5
MOST = 1024
#: Chance that a pair at the threshold shares no band; the number of bands follows from it.
MISS = 2e-8
BASE = 1.05
#: Registers hold 0 to TOP; 2**-64 of the range of a uniform draw is above it.
TOP = 4095
#: Members of the largest component of its buckets that a class outside is compared with in the second round.
SECOND_PICKS = 4
#: A pair is compared on its sets unless its estimate is this many deviations below the threshold.
SLACK = 6.0
MAP_BITS = 1 << 23
#: Counters that order shingles from rare to frequent; any order gives all links, a good one gives fewer candidates.
COUNTERS = 1 << 20
#: Set sizes are grouped in steps of six per cent.
SIZE_STEP = 1.06
#: Words of 64 bits of a set's parity bits: two sets differ in at least as many shingles as in bits.
PARITY = 8
_RNG = np.random.Generator(np.random.PCG64(977))
_TURN, _STEP = _RNG.integers(0, 1 << 63, (2, MOST), dtype=np.uint64) | np.array([[0], [1]], np.uint64)


def _above(x):
    """Chance that one of two registers is the larger, from the share x of draws that only its set makes."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def bands_for(percent: int) -> int:
    """Bands of ROWS registers that a pair of that similarity shares none of with a chance of MISS.

    Registers of two sets agree least often when the sets differ in size as far as they can, but by
    less than the rounding here.
    """
    j = percent / 100
    agree = min(1 - 2 * _above((1 - j) / 2), 1 - _above((1 - j * j) / (1 + j)))
    bands = int(np.ceil(np.log(MISS) / np.log1p(-(agree**ROWS))))
    if bands * ROWS > MOST:
        raise ValueError(f"{percent} per cent asks for {bands * ROWS} registers; there are {MOST}")
    return bands


def registers(minima: np.ndarray) -> np.ndarray:
    """Register values of the smallest uniform draws (as 64-bit numbers)."""
    u = (minima.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + 128, 0, TOP).astype(">u2")


def minima(shingles: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Smallest draw of each of m registers over each run of shingles; one row per run."""
    out = np.empty((len(first), m), np.uint64)
    for i in range(m):
        out[:, i] = np.minimum.reduceat((shingles ^ _TURN[i]) * _STEP[i], first)
    return out


def shingle_sets(at: np.ndarray, data: np.ndarray, size: int):
    """(position, sorted distinct shingle hashes) of every text that has words, by groups."""
    for w in words(at, data, NOT_SPACE, lower=True):
        g = grams(w.hash, size)
        out = []
        for i in range(w.lo, w.hi):
            a, b = w.first[i - w.lo], w.first[i - w.lo + 1]
            if b - a >= size:
                out.append((i, np.unique(g[a : b - size + 1])))
            elif b > a:
                out.append((i, grams(w.hash[a:b], int(b - a))))
        yield out


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def sketches(docs: DataFrame, size: int, m: int, row: Column | None = None) -> DataFrame:
    """(row_id, doc_id, n_shingles, digest, regs): the set's size, its digest and its m registers."""

    def start():
        def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, data = byte_view(batch.column(2))
            n, digest, regs = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for sets in shingle_sets(at, data, size):
                if sets:
                    first = np.cumsum([0] + [len(s) for _, s in sets[:-1]])
                    rows = registers(minima(mix(np.concatenate([s for _, s in sets])), first, m))
                    for (i, s), r in zip(sets, rows, strict=True):
                        n[i], digest[i], regs[i] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), r.tobytes()
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["row_id", "doc_id", "n_shingles", "digest", "regs"])

        return draw

    row = F.monotonically_increasing_id() if row is None else row
    source = docs.select(row.alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(source, start, "row_id bigint, doc_id bigint, n_shingles bigint, digest binary, regs binary")


def full_sets(docs: DataFrame, size: int, bits: np.ndarray) -> DataFrame:
    """(doc_id, digest, shingles) of the rows whose set and id are in the bit map."""
    mask = len(bits) * 8 - 1

    def start():
        def read(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0).to_pylist()
            at, data = byte_view(batch.column(1))
            rows = []
            for sets in shingle_sets(at, data, size):
                for i, s in sets:
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if bits_at(bits, np.array([(_key(digest) ^ (ids[i] or 0)) & mask]))[0]:
                        rows.append((ids[i], digest, s.view(np.int64)))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "digest", "shingles"])

        return read

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), start, "doc_id bigint, digest binary, shingles array<bigint>")


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of highest joint likelihood, given how often each sketch has the larger register."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 401)[None, :] * np.minimum(u / v, v / u)
    up, down = _above(np.maximum(u - v * j, 0)), _above(np.maximum(v - u * j, 0))
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = more[:, None] * log(up) + less[:, None] * log(down) + same[:, None] * log(1 - up - down)
    best = score.argmax(1)
    return j[np.arange(len(best)), best]


@F.pandas_udf(T.DoubleType())
def estimate(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    left, right = (np.frombuffer(b"".join(x), ">u2").reshape(len(x), -1) for x in (a, b))
    if not len(a):
        return pd.Series(np.zeros(0))
    out = [joint_estimate(left[i : i + 1000], right[i : i + 1000], na.to_numpy()[i : i + 1000], nb.to_numpy()[i : i + 1000]) for i in range(0, len(left), 1000)]
    return pd.Series(np.concatenate(out))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets share `percent` of their union."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", shared.alias("n"), (F.size("su") + F.size("sv")).alias("sum")).filter(F.col("n") * 100 >= (F.col("sum") - F.col("n")) * percent).select("u", "v")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles fall on each of COUNTERS counters; each task sends one row per counter at most."""

    def run(batches):
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            n += np.bincount(flat & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    got = sets.select("shingles").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(COUNTERS, np.int64)
    n[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(n, 65_535).astype(np.uint16)  # it goes to every task; beyond, all are frequent


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(token, node, comp, n, pos): the first shingles of each set, rare first, up to where a link must show."""

    def start():
        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for node, comp, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = s.values.to_numpy()
                keep = len(s) - -(-len(s) * percent // 100) + 1
                first = s[np.lexsort((s, counts[s & (COUNTERS - 1)]))[:keep]]
                out.append((first, np.full(len(first), node), np.full(len(first), comp), np.full(len(first), len(s)), np.arange(len(first))))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["token", "node", "comp", "n", "pos"])

        return cut

    return map_arrow(sets.select("node", "comp", "shingles"), start, "token bigint, node bigint, comp bigint, n bigint, pos bigint")


def parities(sets: DataFrame) -> DataFrame:
    """(node, size, b0, b1, ...): for each of 64 * PARITY bits whether an odd number of the set's shingles falls on it."""
    bits = 64 * PARITY

    def start():
        def fold_(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.packbits(np.bincount((s.values.to_numpy() >> 20) & (bits - 1), minlength=bits) & 1).view(np.int64) for s in batch.column(1)]
            table_ = np.array(rows, np.int64).reshape(-1, PARITY)
            sizes = pa.array([len(s) for s in batch.column(1)], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), sizes, *[pa.array(table_[:, i]) for i in range(PARITY)]], names=["node", "size", *[f"b{i}" for i in range(PARITY)]])

        return fold_

    return map_arrow(sets.select("node", "shingles"), start, "node bigint, size bigint, " + ", ".join(f"b{i} bigint" for i in range(PARITY)))


def cross_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) with u < v of different components, all that can be links. `sets` has node, comp, shingles.

    A link of sets x and y, y not the larger, shares at least `need` shingles, so its first common one has
    `need` places from it to the end in both. That bounds y's size from x's place, and the join is by
    shingle and size step. The two sets differ in at most so many shingles, which their parity bits bound
    from below. Of the components that meet at a shingle, the largest isn't paired with itself.
    """
    rows = cut_lineage(prefixes(sets, shingle_counts(sets), percent))
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token")
    shared = cut_lineage(rows.join(mixed, "token"))
    met = shared.groupBy("token", "comp").agg(F.count("*").alias("n"))
    main = met.groupBy("token").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"))
    open_ = cut_lineage(shared.join(main, "token").select("token", "node", "comp", "n", "pos", (F.col("comp") == F.col("main")).alias("inside")))
    step = lambda c: F.floor(F.log(c) / F.log(F.lit(SIZE_STEP))).cast("int")
    most = F.least(F.col("n"), F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent + 1e-6) - F.col("n"))
    least = F.ceil(F.col("n") * percent / 100 - 1e-6)
    x = open_.withColumn("most", most).filter(F.col("most") >= least).withColumn("bin", F.explode(F.sequence(step(least), step(F.col("most")))))
    x = x.select("token", "bin", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"), "inside")
    y = open_.withColumn("bin", step(F.col("n"))).select("token", "bin", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("inside").alias("within"))
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-6)
    ends = (F.col("na") - F.col("pa") >= need) & (F.col("nb") - F.col("pb") >= need)
    pairs = [x.filter("not inside").join(y, ["token", "bin"]), x.filter("inside").join(y.filter("not within"), ["token", "bin"])]
    both = [p.filter("ca != cb and nb <= na").filter(ends).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")) for p in pairs]
    # ids only up to here: what tells two sets apart is fetched once for each pair of them
    found = cut_lineage(both[0].unionByName(both[1]).distinct())
    bits = cut_lineage(parities(sets))
    side = lambda name: bits.select(F.col("node").alias(name), F.col("size").alias(f"n{name}"), *[F.col(f"b{i}").alias(f"{name}{i}") for i in range(PARITY)])
    differ = sum((F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(PARITY)), F.lit(0))
    need = F.ceil((F.col("nu") + F.col("nv")) * percent / (100 + percent) - 1e-6)
    return found.join(side("u"), "u").join(side("v"), "v").filter(differ <= F.col("nu") + F.col("nv") - 2 * need).select("u", "v")


def _seated(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, node, comp) of the classes that share a bucket; a class without links is a component."""
    return cut_lineage(shared.select("bucket", "node").join(label, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp")))


def _main_component(placed: DataFrame) -> DataFrame:
    """(bucket, main) of the buckets that hold several components: the largest one there."""
    part = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    return part.groupBy("bucket").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")


def near_links(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between classes that join everything a chain of links joins."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(bands_for(percent) - 1)), lambda i: F.xxhash64(i, F.col("regs").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    member = classes.select("node", F.explode(pieces).alias("bucket"))
    crowd = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(member.join(crowd, "bucket"))
    nodes = cut_lineage(shared.groupBy("node").agg(F.sum("n").alias("weight")))
    keys = classes.join(nodes, "node", "left_semi").select("node", "doc_id", "digest")
    low = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("bigint")
    bits = bitmap_of(keys.select(low.bitwiseXOR(F.coalesce("doc_id", F.lit(0))).bitwiseAND(MAP_BITS - 1)), MAP_BITS)
    read = full_sets(docs, size, bits).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    sets = cut_lineage(
        read.join(keys.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))), ["doc_id", "digest"]).groupBy("node").agg(F.first("shingles").alias("shingles"))
    )
    # each class with the centre it meets most often
    seat = shared.select("bucket", "node").join(nodes, "node")
    centre = seat.groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
    met = seat.select("bucket", "node").join(centre, "bucket").filter("node != centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    best = cut_lineage(met.groupBy("node").agg(F.max(F.struct("n", "centre"))["centre"].alias("v")).select(F.col("node").alias("u"), "v"))
    star = cut_lineage(confirm(best, sets, percent))
    label = cut_lineage(components(star))
    # then the classes outside the largest component of a bucket with some of its members
    main = _main_component(placed := _seated(shared, label))
    split = cut_lineage(placed.join(main, "bucket"))
    chosen = split.filter("comp = main").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "bucket").alias("o"), "node"))["node"].alias("v"))
    asked = split.filter("comp != main").select("bucket", F.col("node").alias("u")).join(chosen, "bucket").groupBy("u", "v").agg(F.count("*").alias("n"))
    some = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "v"))), 1, SECOND_PICKS)  # of as many as there are bands
    more = cut_lineage(asked.groupBy("u").agg(some.alias("p")).select("u", F.explode("p.v").alias("v")))
    star = star.unionByName(cut_lineage(confirm(more, sets, percent)))
    label = cut_lineage(components(star))
    # then all pairs across components of buckets that still hold several
    placed = _seated(shared, label)
    open_ = cut_lineage(placed.join(_main_component(placed), "bucket", "left_semi").select("node", "comp").distinct())
    best = best.unionByName(more)
    tried = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    cross = cross_pairs(sets.join(open_, "node"), percent).join(tried, ["u", "v"], "left_anti")
    sketch = classes.join(open_, "node", "left_semi").select("node", "regs", "n_shingles")
    left = sketch.select(F.col("node").alias("u"), F.col("regs").alias("ru"), F.col("n_shingles").alias("nu"))
    right = sketch.select(F.col("node").alias("v"), F.col("regs").alias("rv"), F.col("n_shingles").alias("nv"))
    share = percent / 100
    floor = share - SLACK * (share * (1 - share) / (bands_for(percent) * ROWS)) ** 0.5
    likely = cut_lineage(cross.join(left, "u").join(right, "v").filter(estimate("ru", "rv", "nu", "nv") >= floor).select("u", "v"))
    return star.unionByName(cut_lineage(confirm(likely, sets, percent)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, row: Column | None = None) -> DataFrame:
    """(row_id, doc_id, n_shingles, component_id, keeper): `keeper` marks one row of each group.

    row_id is the column `row` of distinct numbers. Without it it is the row number of one scan, which
    another scan need not repeat.
    """
    rows = cut_lineage(sketches(docs, size, bands_for(percent) * ROWS, row))
    full = rows.filter("digest is not null")
    classes = cut_lineage(
        full.groupBy("digest").agg(
            F.min("row_id").alias("node"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs")
        )
    )
    label = cut_lineage(components(near_links(docs, classes, size, percent)))
    named = classes.select("digest", "node", "doc_id").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # both small sides are written, so that the joins may split the rows of a large component
    first = cut_lineage(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    named = cut_lineage(named.join(first, "comp").select("digest", "comp", "component_id"))
    out = rows.join(named, "digest", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    out = out.select("row_id", "doc_id", "n_shingles", "component_id", F.coalesce("comp", "row_id").alias("comp"))
    # one row of each component: the smallest id, ties by row
    pick = out.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_id"))["row_id"].alias("chosen"))
    return out.join(cut_lineage(pick), "comp").select("row_id", "doc_id", "n_shingles", "component_id", (F.col("row_id") == F.col("chosen")).alias("keeper"))


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
