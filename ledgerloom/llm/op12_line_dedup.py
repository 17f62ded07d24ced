"""Line deduplication by range-partitioned hashes; the result is a keep bitmap per document, not text.

Every line becomes a row (hash of its key, document, position), a few dozen bytes. The rows are
range-partitioned by hash and document and sorted by hash, document and position, so the
occurrences of a key stream by in corpus order: the first of each document counts that document,
the very first is the one that `keep="first"` leaves. Sums per key combine before their shuffle.
Lines of frequent keys are then marked, 64 positions a word, and a document's words that are not all
ones are its compressed keep bitmap: a document that loses nothing has none.

The range key holds the document beside the hash, so a key that a third of all lines share is
spread over many ranges, and its lines meet the table of frequent keys (at most 1 / `min_docs` of all
lines, one row each) in a join whose large side may be split. Keys are compared by two 64-bit hashes;
that two different keys among 10^13 agree in both has a chance of 10^-13.

DataFrame functions only. Cases: a null or empty text is one empty line; a key shorter than
`min_chars` is never dropped; a line repeated inside one document counts that document once; repeated
rows, also of one doc_id, are documents of their own, as are rows with a null doc_id; order among
equal doc_ids is that of the rows in the files; a document that loses all its lines keeps the empty
text; very long texts are split in memory, one text at a time, and their bitmaps take a bit for each
line of a touched word; other columns pass through `mark_lines` untouched, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER, cut_lineage, numbered, table

BLANKS = "\t\n\x0b\x0c\r "
MIN_CHARS, MIN_DOCS = 1, 10
WORD_BITS = 64


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_places(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, row_id, pos, leads): a row per line with a long enough key, in hash ranges, in corpus order.

    `leads` marks the first occurrence in its document.
    """
    lines = docs.select("doc_id", "row_id", F.posexplode(F.transform(text_lines(F.col("text")), line_key)).alias("pos", "key"))
    lines = lines.filter(F.char_length("key") >= min_chars)
    hashed = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_id", "pos")
    ranged = hashed.repartitionByRange("h1", "h2", "doc_id", "row_id").sortWithinPartitions("h1", "h2", "doc_id", "row_id", "pos")
    # the ranges and the sort above are what this window asks for
    stream = Window.partitionBy("h1", "h2", "doc_id", "row_id").orderBy("pos")
    return ranged.withColumn("leads", F.row_number().over(stream) == 1)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "none") -> DataFrame:
    """(row_id, n_dropped, bitmap) of the documents that lose lines.

    A line goes when its key is found in `min_docs` documents or more; `keep="first"` leaves the key's
    first occurrence in order of doc_id (null first), file row and position. `bitmap` is an array of (word, bits) in
    order: bit j of word w tells whether line 64 w + j stays; words left out are all ones.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    places = cut_lineage(line_places(docs, min_chars))
    first = F.min(F.struct(F.col("doc_id").alias("d"), F.col("row_id").alias("r"), F.col("pos").alias("p"))).alias("first")
    frequent = places.groupBy("h1", "h2").agg(F.count_if("leads").alias("n_docs"), first).filter(F.col("n_docs") >= min_docs)
    dropped = places.join(cut_lineage(frequent), ["h1", "h2"])
    if keep == "first":
        dropped = dropped.filter((F.col("row_id") != F.col("first.r")) | (F.col("pos") != F.col("first.p")))
    bit = F.expr(f"shiftleft(1L, pos % {WORD_BITS})")
    words = dropped.groupBy("row_id", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    lost = F.sum(WORD_BITS - F.bit_count("bits")).cast("long").alias("n_dropped")
    return words.groupBy("row_id").agg(lost, F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines of `text` that `bitmap` keeps, joined; one pass over the lines."""
    lines = text_lines(text)
    ones = lambda words: F.repeat(F.lit("1"), (words * WORD_BITS).cast("int"))
    flags = lambda bits: F.reverse(F.lpad(F.bin(bits), WORD_BITS, "0"))
    gaps = F.transform(bitmap, lambda x, i: F.concat(ones(x["word"] - F.when(i > 0, F.get(bitmap, i - 1)["word"] + 1).otherwise(0)), flags(x["bits"])))
    marks = F.split(F.rpad(F.array_join(gaps, ""), F.size(lines), "1"), "")
    return F.array_join(F.zip_with(lines, marks, lambda line, mark: F.when(mark == "1", line)), "\n")


def mark_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "none") -> DataFrame:
    """`docs` as a struct `doc`, with n_lines, n_dropped and the keep bitmap (null: all lines stay)."""
    narrow = numbered(docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc")))
    marks = keep_bitmaps(narrow, min_chars, min_docs, keep)
    out = narrow.join(marks, "row_id", "left")
    return out.select("doc", F.size(text_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "bitmap")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.col("doc.text")
    kept = F.when(F.col("bitmap").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept_text(text, F.col("bitmap")))
    return marked.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE len(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
