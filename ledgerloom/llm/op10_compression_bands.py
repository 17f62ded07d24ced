"""Quality rules by compression bands.

Every text is compressed whole and in fixed chunks with zstandard. A text far more compressible
than prose of its length is repetitive, one that hardly compresses is noise; either is rejected, and
so is a text whose chunks are too often one or the other. Chunks have a fixed size; the last one ends
where the text ends, overlapping the one before, so every byte of a text of a chunk or more is judged.
The limits depend on the length because short texts give the compressor little to work with, and
because a long one has room for a table or a list that says little of the rest.

How the limits were chosen, on the texts of the test tables labelled good: whole ratios are 0.50 to
0.82 from 200 bytes, 0.46 to 0.61 from 1,000, 0.43 to 0.55 from 2,048, 0.39 to 0.47 from 8,000, and
chunks are 0.45 to 0.56 at every length. Scripts of wider characters reach 0.7. A repeated phrase
comes to 0.02, random letters to 0.74, random printable bytes to 0.84. The limits lie between.

Cases: null and empty texts have no words and fail the base rule; a text shorter than the smallest
band has no ratio limits, one shorter than a chunk no chunks; a ratio equal to a limit fits; a very
long text is compressed whole, a batch of at most 2,000 rows at a time; rows are judged one by one, so repeated rows get equal verdicts; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import map_arrow, table
from ledgerloom.llm.words import NOT_SPACE, byte_view, grams, words

#: (bytes from, lowest and highest ratio, lowest and highest of a chunk, share of chunks outside from which a text goes);
#: the last that fits the length holds.
BANDS = (
    (0, 0.0, 9.9, 0.20, 0.72, 0.5),
    (200, 0.25, 0.95, 0.20, 0.72, 0.5),
    (1000, 0.22, 0.80, 0.20, 0.72, 0.5),
    (4000, 0.20, 0.75, 0.20, 0.72, 0.5),
    (20000, 0.18, 0.72, 0.18, 0.72, 0.34),
)
CHUNK_BYTES = 2048
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks bigint, n_chunks bigint"
)
BLANK = " \t\n\v\f\r"


def repeated_words(h: np.ndarray, width: int = 8) -> int:
    """Words inside windows of `width` words that occur twice or more."""
    g = grams(h, width)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def chunk_starts(size: int) -> list[int]:
    """Where the chunks of a text of that many bytes begin; together they cover it."""
    starts = list(range(0, size - CHUNK_BYTES + 1, CHUNK_BYTES))
    return [*starts, size - CHUNK_BYTES] if starts and size % CHUNK_BYTES else starts


def band_verdict(raw: bytes, level: zstandard.ZstdCompressor, bands: Sequence) -> tuple[bool, float | None, int, int]:
    """Whether the ratios fit, the whole ratio, the chunks outside their limits, and all chunks."""
    if not raw:
        return True, None, 0, 0
    ratio = len(level.compress(raw)) / len(raw)
    _, low, high, least, most, share = [b for b in bands if len(raw) >= b[0]][-1]
    parts = [len(level.compress(raw[i : i + CHUNK_BYTES])) / CHUNK_BYTES for i in chunk_starts(len(raw))]
    bad = sum(not least <= p <= most for p in parts)
    return low <= ratio <= high and (not parts or bad < share * len(parts)), ratio, bad, len(parts)


def compression_rules(docs: DataFrame, bands: Sequence = BANDS) -> DataFrame:
    """Base counts and the verdict of every document, read in one pass without a shuffle."""

    def start():
        level = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        symbol = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
        # bytes 0x80 to 0xBF continue a character
        lead = (np.arange(256) & 0xC0) != 0x80

        def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, column = batch.column(0), batch.column(1)
            at, data = byte_view(column)
            texts = column.to_pylist()
            rows = []
            for w in words(at, data, NOT_SPACE, lower=False):
                for i in range(w.lo, w.hi):
                    a, b = w.first[i - w.lo], w.first[i - w.lo + 1]
                    raw, text = data[at[i] : at[i + 1]], texts[i] or ""
                    n, repeats = int(b - a), repeated_words(w.hash[a:b])
                    failed = n < 20 or 100 * repeats > 30 * n
                    fits, ratio, bad, full = band_verdict(raw.tobytes(), level, bands)
                    rows.append((n, int((NOT_SPACE & lead)[raw].sum()), int(symbol[raw].sum()), duplicate_lines(text), repeats, failed, not failed and fits, ratio, bad, full))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([ids, *cols], names=names)

        return judge

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), start, SCHEMA)


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(table(spark, sf_dir, "documents"))


#: The base columns; the verdict rests on zstandard, which SQL has not.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS gram, len(w) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 8) t(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(h.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
"""
