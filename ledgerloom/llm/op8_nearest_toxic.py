"""Toxicity by the nearest labelled examples.

Texts are vectors of TF-IDF weights over evidence terms: words and word beginnings of four to six
letters whose presence in labelled texts goes with the label (log-likelihood ratio). The examples'
vectors stand in an inverted index: postings per term, cut into blocks of examples with the largest
weight of each block. A text's exact nearest examples by cosine come from the blocks of highest upper
bound, and then those whose bound reaches the k-th best so far. Votes are weighted by cosine and
smoothed with the share of label 1 among examples, which gives a probability; the neighbours' ids are
the evidence. A text without evidence terms is nearest to the examples that have none either.

Bounds: `SAMPLE_ROWS` labelled texts of up to `SAMPLE_CHARS` characters fit terms and index, at most
`TERMS` terms are kept. Document frequencies count all documents: each task sends one row per term.

Cases: null and empty texts have no terms and score like all texts without; without labels the score
is 0; repeated rows get equal scores; equally near examples are ordered by their place in the index; very
long texts are scored whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.common import fold, map_arrow, table, text_rows
from ledgerloom.llm.sample import labelled_sample

SAMPLE_ROWS, SAMPLE_CHARS = 12_000, 40_000
TERMS, LEAST_RATIO, LEAST_DOCS = 1024, 15.0, 3
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 15, 32, 8
#: Votes for the share of label 1 that stand beside the neighbours'.
PRIOR_VOTES = 0.5
STARTS = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> Counter:
    """Words and marked word beginnings of a text with their counts."""
    count = Counter(WORD.findall((text or "").lower()))
    out = Counter(count)
    for w, n in count.items():
        for k in STARTS:
            if len(w) > k:
                out[w[:k] + "~"] += n
    return out


class Vocabulary:
    """Finds the kept terms of a text with set operations, counting only where one is there."""

    def __init__(self, terms: list[str]):
        self.at = {t: i for i, t in enumerate(terms)}
        self.words = {t for t in terms if t[-1] != "~"}
        self.starts = [(k, {t[:-1] for t in terms if t[-1] == "~" and len(t) == k + 1}) for k in STARTS]

    def counts(self, text: str | None) -> dict[int, int]:
        if not text:
            return {}
        found = WORD.findall(text.lower())
        seen = set(found)
        some = bool(self.words & seen) or any(s and not s.isdisjoint({w[:k] for w in seen if len(w) > k}) for k, s in self.starts)
        if not some:
            return {}
        out: Counter = Counter()
        for w, n in Counter(found).items():
            if w in self.words:
                out[self.at[w]] += n
            for k, s in self.starts:
                if len(w) > k and w[:k] in s:
                    out[self.at[w[:k] + "~"]] += n
        return out


def weights(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers in order and their weights, of length 1."""
    at = np.array(sorted(counts), np.int64)
    w = np.array([1 + np.log(counts[t]) for t in at.tolist()]) * idf[at]
    norm = np.sqrt((w * w).sum())
    return at, w / norm if norm else w


@dataclass
class Index:
    """Examples in blocks of alike ones: per term its postings and the largest weight in each block."""

    terms: list[str]
    idf: np.ndarray
    ids: np.ndarray
    y: np.ndarray
    posts: list[tuple[np.ndarray, np.ndarray]]
    tops: np.ndarray
    share: float
    bare: float

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a term in common; equal ones by position.

        The blocks of highest bound give a k-th best; then just those whose bound reaches it are read.
        """
        bound = w @ self.tops[at]
        acc, open_ = np.zeros(len(self.ids)), np.zeros(len(bound), bool)
        first = np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]
        open_[first] = True
        self._add(at, w, open_, acc)
        kth = np.partition(acc, -k)[-k] if len(acc) >= k else 0.0
        open_ = (bound > 0) & (bound >= kth - 1e-12)
        open_[first] = False
        self._add(at, w, open_, acc)
        best = np.flatnonzero(acc >= max(kth - 1e-12, 1e-300))
        best = best[np.lexsort((best, -np.round(acc[best], 12)))[:k]]
        return best, acc[best]

    def _add(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray, acc: np.ndarray) -> None:
        """Add the products of the terms' postings in the open blocks."""
        for t, x in zip(at.tolist(), w.tolist(), strict=True):
            docs, vals = self.posts[t]
            read = blocks[docs // BLOCK]
            acc[docs[read]] += x * vals[read]

    def score(self, counts: dict[int, int], k: int = NEIGHBOURS) -> tuple[float, list[int]]:
        if not counts:
            return self.bare, []
        best, sims = self.nearest(*weights(counts, self.idf), k)
        votes = (sims * self.y[best]).sum() + PRIOR_VOTES * self.share
        return float(votes / (sims.sum() + PRIOR_VOTES)), self.ids[best].tolist()


def build_index(terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]]) -> Index:
    """Index of (id, label, counts); the examples without terms only give the score of texts without."""
    ys = np.array([y for _, y, _ in examples], float)
    share = float((ys.sum() + 1) / (len(ys) + 2)) if len(ys) else 0.0
    plain = [y for _, y, c in examples if not c]
    bare = (sum(plain) + share) / (len(plain) + 1)
    # the order brings alike examples into one block; equal ones stay in id order
    rows = sorted(((i, y, c) for i, y, c in examples if c), key=lambda r: (max(r[2], key=lambda t: (idf[t], t)), r[0]))
    blocks = len(rows) // BLOCK + 1
    lists: list[list] = [[] for _ in terms]
    for p, (_, _, c) in enumerate(rows):
        for t, x in zip(*weights(c, idf), strict=True):
            lists[t].append((p, x))
    posts = [(np.array([p for p, _ in one], np.int64), np.array([x for _, x in one])) for one in lists]
    tops = np.zeros((len(terms), blocks))
    for t, (docs, vals) in enumerate(posts):
        np.maximum.at(tops[t], docs // BLOCK, vals)
    return Index(terms, idf, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), posts, tops, share, bare)


def _pick_terms(sample: DataFrame, limit: int) -> list[str]:
    """Terms that go with the label, the strongest first; the counts meet in an aggregate."""

    def start():
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            one, all_ = Counter(), Counter()
            for text, y in zip(text_rows(batch), text_rows(batch, "y"), strict=True):
                found = terms_of(text).keys()
                all_.update(found)
                if y:
                    one.update(found)
            return pa.RecordBatch.from_pydict({"term": list(all_), "n": list(all_.values()), "ones": [one[t] for t in all_]}, schema=pa.schema([("term", pa.string()), ("n", pa.int64()), ("ones", pa.int64())]))

        return count

    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        return []
    found = map_arrow(sample, start, "term string, n bigint, ones bigint", 1 << 20).groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("a")).filter(F.col("n") >= LEAST_DOCS)
    c = {"a": F.col("a"), "b": F.col("n") - F.col("a"), "c": ones - F.col("a"), "d": n - ones - F.col("n") + F.col("a")}
    even = {"a": F.col("n") * ones / n, "b": F.col("n") * (n - ones) / n, "c": (n - F.col("n")) * ones / n, "d": (n - F.col("n")) * (n - ones) / n}
    ratio = sum((F.when(c[k] > 0, c[k] * F.log(c[k] / even[k])).otherwise(0.0) for k in "abcd"), F.lit(0.0)) * 2
    top = found.withColumn("ratio", ratio).filter((F.col("ratio") >= LEAST_RATIO) & (c["a"] > 2 * even["a"]))
    return [r.term for r in top.orderBy(F.desc("ratio"), "term").limit(limit).collect()]


def _document_frequency(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and the number of documents."""

    def run(batches):
        vocabulary, n, rows = Vocabulary(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                for t in vocabulary.counts(text.as_py()):
                    n[t] += 1
        yield pa.RecordBatch.from_pydict({"term": np.arange(len(terms) + 1), "n": np.append(n, rows)})

    got = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(len(terms) + 1, np.int64)
    for r in got:
        n[r.term] = r.n
    return n[:-1], int(n[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, label: str = "toxic", rows: int = SAMPLE_ROWS, limit: int = TERMS) -> Index:
    """Terms and examples from a bounded sample of labelled rows; frequencies over all of `corpus` (default: docs)."""
    sample = labelled_sample(docs, labels, label, rows, SAMPLE_CHARS, per_label=False)
    terms = _pick_terms(sample, limit)
    df, n = _document_frequency(docs if corpus is None else corpus, terms)
    idf = np.log((n + 1) / (df + 1)) + 1
    vocabulary_terms = list(terms)

    def start():
        vocabulary = Vocabulary(vocabulary_terms)

        def vector(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [vocabulary.counts(t) for t in text_rows(batch)]
            cols = [batch.column(0), batch.column(2), pa.array([list(c) for c in got], pa.list_(pa.int64())), pa.array([list(c.values()) for c in got], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "t", "n"])

        return vector

    rows_ = map_arrow(sample, start, "doc_id bigint, y int, t array<bigint>, n array<bigint>").collect()
    return build_index(terms, idf, sorted((r.doc_id, r.y, dict(zip(r.t, r.n, strict=True))) for r in rows_))


def _per_text(index: Index, kind: T.DataType, take):
    """Arrow function over texts; the term sets are built once per task."""
    ready: list[Vocabulary] = []

    @F.arrow_udf(kind)
    def judge(text: pa.Array) -> pa.Array:
        if not ready:
            ready.append(Vocabulary(index.terms))
        return pa.array((take(index.score(ready[0].counts(t.as_py()))) for t in text), kind_arrow)

    kind_arrow = to_arrow_type(kind)
    return judge


def toxicity_score(index: Index):
    """Column function from a text to its probability of label 1; one pass, no shuffle."""
    return _per_text(index, T.DoubleType(), lambda found: found[0])


def toxicity_evidence(index: Index):
    """Column function from a text to (score, evidence): the ids of its nearest examples, nearest first."""
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])
    return _per_text(index, kind, lambda found: {"score": found[0], "evidence": found[1]})


def op8_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = fit_toxicity(docs, labels.filter(~fold("doc_id", 3, 1)))
    scored = docs.select("doc_id", toxicity_evidence(index)("text").alias("found")).select("doc_id", "found.score", "found.evidence")
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
