"""Language identification by words first, character n-grams second.

A known word adds its log frequency in each language. An unseen word falls back to its five-letter
grams (word ends marked), averaged over the known ones; if none is known to its four-letter grams, and
so on down to single letters. The language of the highest mean is the answer, its posterior the score.

The model is fitted on a bounded sample (`SAMPLE_ROWS` texts by id hash) and keeps the most frequent
`WORDS` words and `GRAMS` grams, counted by an aggregate; that bounds what the driver and the tasks
hold. Every whole text is read once, without a shuffle.

Cases: `und` with score 0 for null texts, texts without a letter, and where nothing was learned; ties go to
the first language by code point; repeated rows get equal answers; rows without language or text teach
nothing; very long texts are read whole, but do not teach; words and n-grams that the sample holds only
once are not in the model, nor those beyond the documented numbers of words and n-grams, and are
scored by shorter n-grams; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, fold, map_arrow, table, text_rows

SAMPLE_ROWS, SAMPLE_CHARS = 4000, 40_000
WORDS, GRAMS = 60_000, 60_000
LONGEST = 5
SMOOTH = 0.5
#: Word scores kept between texts of one task.
KEEP = 200_000
WORD = re.compile(r"[^\W\d_]+")


def word_list(text: str | None) -> list[str]:
    """Lower-case runs of letters; a run of letter-like numerals only is none."""
    found = WORD.findall((text or "").lower())
    return found if found and all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [word] if n == 1 and len(word) == 1 else [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Languages in code point order, and for kind 0 (words) and each gram length the row of an item in `logs`."""

    langs: list[str]
    rows: list[dict[str, int]]
    logs: np.ndarray

    def word_score(self, word: str) -> np.ndarray:
        at = self.rows[0].get(word)
        if at is not None:
            return self.logs[at]
        for n in range(LONGEST, 0, -1):
            known = self.rows[n]
            at = [known[g] for g in grams_of(word, n) if g in known]
            if at:
                return self.logs[at].mean(0)
        return np.zeros(len(self.langs))


def _count(sample: DataFrame) -> DataFrame:
    """(lang, kind, item, n): kind 0 counts words, kind k grams of k letters, by token."""

    def start():
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            words: Counter = Counter()
            for text, lang in zip(text_rows(batch), text_rows(batch, "lang"), strict=True):
                words.update((lang, w) for w in word_list(text))
            out: Counter = Counter()
            for (lang, w), c in words.items():
                out[lang, 0, w] += c
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        out[lang, n, g] += c
            cols = zip(*((*k, c) for k, c in out.items()), strict=True) if out else ((), (), (), ())
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["lang", "kind", "item", "n"])

        return count

    return map_arrow(sample, start, "lang string, kind int, item string, n bigint", 500).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, rows: int = SAMPLE_ROWS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """The model of `docs` (doc_id, text, lang), from the `rows` texts of smallest id hash."""
    pick = docs.filter("doc_id is not null and lang is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.filter("lang is not null and text is not null").filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text", "lang").join(F.broadcast(pick), "doc_id")
    counts = cut_lineage(_count(sample))
    sums = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in sums})
    total = {(r.lang, r.kind): r.n for r in sums}
    by_item = counts.groupBy("kind", "item").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    rows_, logs = [{} for _ in range(LONGEST + 1)], []
    for is_word, limit in ((True, words), (False, grams)):
        top = by_item.filter((F.col("kind") == 0) == F.lit(is_word)).filter("all > 1").orderBy(F.desc("all"), "kind", "item").limit(limit).collect()
        for r in top:
            rows_[r.kind][r.item] = len(logs)
            logs.append([(r.by.get(g, 0) + SMOOTH) / (total.get((g, r.kind), 0) + SMOOTH * limit) for g in langs])
    return Model(langs, rows_, np.log(np.array(logs).reshape(len(logs), len(langs))))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, in one pass."""

    def start():
        known: dict[str, int] = {}
        matrix = np.zeros((KEEP, max(1, len(model.langs))))

        def row_of(word: str) -> int:
            at = known[word] = len(known)
            matrix[at] = model.word_score(word)
            return at

        def judge(text: str | None) -> tuple[str, float]:
            found = word_list(text)
            if not found or not model.langs:
                return "und", 0.0
            total = np.zeros(len(model.langs))
            for i in range(0, len(found), KEEP // 2):
                part = found[i : i + KEEP // 2]
                if len(known) + len(part) > KEEP:
                    known.clear()
                at = [known[w] if w in known else row_of(w) for w in part]
                total += matrix[at].sum(0)
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            return model.langs[best], float(odds[best] / odds.sum())

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [judge(t) for t in text_rows(batch)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return run

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), start, "doc_id bigint, lang_pred string, score double")


def op4_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(~fold("doc_id", 4, 2)))
    return identify(docs, model).select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
