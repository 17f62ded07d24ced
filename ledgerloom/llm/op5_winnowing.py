"""Benchmark decontamination by winnowing.

The fingerprint of a window of `WINDOW` words is the smallest hash of the K-word grams in it, so a
shared span of WINDOW words always shares a fingerprint. Training texts look their fingerprints up in
a bit map of the test fingerprints, those that may match are joined with the test fingerprints, and
each hit is extended to the whole window by comparing its words. An item of fewer words is one window.

The bit map has a fixed size whatever the size of the test set; it only spares shuffled rows, the
join decides. The join key holds the window's words, and a window is there once on the test side, so
a passage that many texts share is a skewed join with one partner per row, which Spark splits.

Cases: null and empty texts have no words and no hits; a test row without item_id hits words but
names no item; rows with the same item_id are one item; repeated documents are judged row by row;
an empty test set hits nothing, an empty table gives an empty result; a window keeps
its smallest hash whatever its place, and windows are compared by all their words, so ties of hashes
add and lose no hit; very long texts are read whole, a block at a time; columns of other names are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bitmap_of, bits_at, cut_lineage, map_arrow, table
from ledgerloom.llm.words import ALNUM, AS_LOWER, byte_view, grams, mix, words

WINDOW = 10
K = 5
MAP_BITS = 1 << 22


def fingerprints(h: np.ndarray, length: int, k: int = K) -> np.ndarray:
    """Winnowed hash of the window of `length` words at each place."""
    k = min(k, length)
    g = grams(h, k)
    out = g[: max(0, len(g) - (length - k))]
    for j in range(1, length - k + 1):
        out = np.minimum(out, g[j : j + len(out)])
    return mix(out ^ np.uint64(length)).view(np.int64)


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, fp, gram) of every window of every item."""

    def start():
        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, data = byte_view(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), []
            for w in words(at, data, ALNUM, lower=True):
                for i in range(w.lo, w.hi):
                    a, b = w.first[i - w.lo], w.first[i - w.lo + 1]
                    length = int(min(window, b - a))
                    if length:
                        text = [AS_LOWER[data[s:e]].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
                        for p, fp in enumerate(fingerprints(w.hash[a:b], length).tolist()):
                            rows.append((ids[i], length, fp, " ".join(text[p : p + length])))
            return pa.RecordBatch.from_pylist([dict(zip(("item_id", "length", "fp", "gram"), r, strict=True)) for r in rows], schema=schema)

        schema = pa.schema([("item_id", pa.int64()), ("length", pa.int32()), ("fp", pa.int64()), ("gram", pa.string())])
        return cut

    return map_arrow(items.selectExpr("cast(item_id as bigint) item_id", "text"), start, "item_id bigint, length int, fp bigint, gram string", 200).distinct()


def find_candidates(docs: DataFrame, lengths: list[int], bits: np.ndarray, row: Column | None = None) -> DataFrame:
    """(row_id, doc_id, n_words, found): windows whose fingerprint is in the bit map, with their words."""
    entry = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("fp", pa.int64()), ("gram", pa.string())])
    mask = np.int64(len(bits) * 8 - 1)

    def start():
        def look(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, data = byte_view(batch.column(2))
            counts, found = [], [None] * batch.num_rows
            for w in words(at, data, ALNUM, lower=True):
                counts.append(np.diff(w.first))
                doc = np.repeat(np.arange(w.lo, w.hi), counts[-1])
                for length in lengths:
                    fp = fingerprints(w.hash, length)
                    for p in np.flatnonzero(bits_at(bits, fp & mask)).tolist():
                        if doc[p] == doc[p + length - 1]:
                            gram = b" ".join(AS_LOWER[data[s:e]].tobytes() for s, e in zip(w.start[p : p + length], w.end[p : p + length], strict=True))
                            i = int(doc[p])
                            found[i] = found[i] or []
                            found[i].append({"start": p - int(w.first[i - w.lo]), "length": length, "fp": int(fp[p]), "gram": gram.decode()})
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(entry))], names=["row_id", "doc_id", "n_words", "found"])

        return look

    row = F.monotonically_increasing_id() if row is None else row
    source = docs.select(row.alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(source, start, "row_id bigint, doc_id bigint, n_words bigint, found array<struct<start int, length int, fp bigint, gram string>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, map_bits: int = MAP_BITS, row: Column | None = None) -> DataFrame:
    """One row per document: row_id (the column `row`, else the row number of one scan), words, hit words, items hit, and the digest of their ids."""
    windows = cut_lineage(test_windows(items, window))
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    bits = bitmap_of(windows.select(F.col("fp").bitwiseAND(map_bits - 1)), map_bits)
    rows = cut_lineage(find_candidates(docs, lengths, bits, row))
    maybe = rows.filter("found is not null").select("row_id", F.inline("found"))
    hits = cut_lineage(maybe.join(windows.select("fp", "gram").distinct(), ["fp", "gram"], "left_semi"))
    spans = F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["upto"]))).cast("long").alias("n"),
            F.greatest(a["upto"], s["stop"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    n_hit = hits.groupBy("row_id").agg(covered.alias("n_hit"))
    named = windows.filter("item_id is not null").select("item_id", "fp", "gram")
    pairs = hits.select("row_id", "fp", "gram").distinct().join(named, ["fp", "gram"]).select("row_id", "item_id").distinct()
    ids = F.sort_array(F.collect_list(F.col("item_id").cast("string")))
    by_row = pairs.groupBy("row_id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return (
        rows.select("row_id", "doc_id", "n_words")
        .join(n_hit, "row_id", "left")
        .join(by_row, "row_id", "left")
        .select(
            "row_id",
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_id")


ORACLE = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bl AS (SELECT item_id, w, least(len(w), 10) AS l FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i+l-1], ' ') AS gram FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, i, l, array_to_string(w[i:i+l-1], ' ') AS gram FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, l, gram FROM dg WHERE gram IN (SELECT gram FROM win)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit JOIN win USING (l, gram)) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, hw.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
