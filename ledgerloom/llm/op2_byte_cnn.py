"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become fixed feature vectors (kind of character and a few random signs). Learned filters
eight bytes wide slide over the whole text in steps of four; their rectified responses are max-pooled
over chunks of 512 bytes that overlap by half. A hidden layer looks at each chunk, the maximum and
the mean of its units over all chunks make one probability by logistic regression.

It is fitted on a bounded sample of labelled rows (`SAMPLE_ROWS` of each label, texts up to
`SAMPLE_CHARS`); the share of the labels over all labelled rows sets the bias. The fitted filters
are a few thousand numbers. Texts are scored in slices of 256 KiB at most, so memory does not grow
with a text's length.

Cases: null and empty texts are scored as one chunk of padding; without labels, or with one label
only, every score is the smoothed share of label 1 (0.5 without labels); repeated rows get equal
scores; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import fold, table
from ledgerloom.llm.sample import labelled_sample
from ledgerloom.llm.words import byte_view

SAMPLE_ROWS, SAMPLE_CHARS = 1000, 40_000
EPOCHS, BATCH = 8, 24
FILTERS, HIDDEN = 16, 12
STEP, SEGMENT = 4, 256
SLICE = 1 << 18


def byte_features() -> np.ndarray:
    """256 x 12: eight kinds of byte and four random signs."""
    b = np.arange(256)
    chr_in = lambda s: np.isin(b, np.frombuffer(s, np.uint8))
    kinds = [
        (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), chr_in(b" \t\r"),
        b == 10, chr_in(b".,;:'\"!?()-"), (b > 32) & (b < 127) & ~chr_in(b".,;:'\"!?()-") & ~np.char.isalnum(np.array([chr(x) for x in b])), b >= 128,
    ]
    signs = np.random.default_rng(11).choice([-0.5, 0.5], (256, 4))
    signs[0] = 0
    return np.concatenate([np.array(kinds).T, signs], axis=1).astype(np.float32)


FEATURES = byte_features()
WIDTH = FEATURES.shape[1] * STEP


@dataclass
class Net:
    """Weights: filters over two steps, hidden layer over a chunk's filters, output over maxima and means."""

    wa: np.ndarray
    wb: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w3: np.ndarray
    b3: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [self.wa, self.wb, self.b1, self.w2, self.b2, self.w3, self.b3]


def fresh(seed: int = 5) -> Net:
    r = np.random.default_rng(seed)
    draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    zero = lambda *s: np.zeros(s, np.float32)
    return Net(draw(WIDTH, FILTERS), draw(WIDTH, FILTERS), zero(FILTERS), draw(FILTERS, HIDDEN), zero(HIDDEN), draw(2 * HIDDEN), zero(1))


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text padded with zeros to whole segments past its end, and segments per text."""
    n = np.array([(len(t) + STEP) // SEGMENT + 1 for t in texts])
    flat = np.zeros(int(n.sum()) * SEGMENT, np.uint8)
    at = 0
    for t, k in zip(texts, n, strict=True):
        flat[at : at + len(t)] = t
        at += k * SEGMENT
    return flat, n


def segments(net: Net, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step vectors, filter responses, and their maximum in each segment."""
    a = FEATURES[flat].reshape(-1, WIDTH)
    y = a @ net.wa
    y[:-1] += a[1:] @ net.wb
    y += net.b1
    y[np.cumsum(n) * (SEGMENT // STEP) - 1] = 0  # would look into the next text
    np.maximum(y, 0, out=y)
    return a, y, y.reshape(-1, SEGMENT // STEP, FILTERS).max(1)


def chunk_hidden(net: Net, s: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks are a segment and the next one of the same text; their hidden units."""
    follow = np.concatenate([s[1:], s[-1:]])
    follow[last] = s[last]
    c = np.maximum(s, follow)
    return c, np.maximum(c @ net.w2 + net.b2, 0)


def score_texts(net: Net, texts: list[np.ndarray]) -> np.ndarray:
    """Probabilities of a group of texts of bounded size."""
    flat, n = padded(texts)
    s = segments(net, flat, n)[2]
    first = np.cumsum(n) - n
    h = chunk_hidden(net, s, np.cumsum(n) - 1)[1]
    top, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / n[:, None]
    return np.concatenate([top, mean], 1) @ net.w3 + net.b3


def score_long(net: Net, text: np.ndarray) -> float:
    """The same for one long text, a slice at a time; slices share one segment, so chunks cross them."""
    total, top, sums, at = (len(text) + STEP) // SEGMENT + 1, np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN), 0
    per = SLICE // SEGMENT
    while at < total:
        k = min(per, total - at)
        more = at + k < total
        flat = np.zeros((k + 2 * more) * SEGMENT, np.uint8)
        part = text[at * SEGMENT : at * SEGMENT + len(flat)]
        flat[: len(part)] = part
        s = segments(net, flat, np.array([k + 2 * more]))[2]
        h = chunk_hidden(net, s, np.array([len(s) - 1]))[1][:k]
        top, sums, at = np.maximum(top, h.max(0)), sums + h.sum(0), at + k
    return float(np.concatenate([top, sums / total]) @ net.w3 + net.b3[0])


def gradients(net: Net, texts: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    flat, n = padded(texts)
    a, resp, s = segments(net, flat, n)
    ends = np.cumsum(n)
    first, doc = ends - n, np.repeat(np.arange(len(n)), n)
    follow = np.concatenate([s[1:], s[-1:]])
    follow[ends - 1] = s[ends - 1]
    c, h = chunk_hidden(net, s, ends - 1)
    top, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / n[:, None]
    f = np.concatenate([top, mean], 1)
    d = ((1 / (1 + np.exp(-np.clip(f @ net.w3 + net.b3, -30, 30))) - y) / len(y)).astype(np.float32)
    dtop, dmean = d[:, None] * net.w3[:HIDDEN], d[:, None] * net.w3[HIDDEN:] / n[:, None]
    tied = (h == top[doc]).astype(np.float32)  # chunks that share the maximum share its gradient
    dh = (dmean[doc] + tied / np.add.reduceat(tied, first)[doc] * dtop[doc]) * (h > 0)
    dc = dh @ net.w2.T
    mine = s >= follow
    ds = np.where(mine, dc, 0)
    ds[1:] += np.where(mine, 0, dc)[:-1]
    t = resp.reshape(-1, SEGMENT // STEP, FILTERS).argmax(1) + np.arange(len(s))[:, None] * (SEGMENT // STEP)
    ds = ds * (s > 0)
    ga, gb = np.empty_like(net.wa), np.empty_like(net.wb)
    for k in range(FILTERS):
        ga[:, k] = ds[:, k] @ a[t[:, k]]
        gb[:, k] = ds[:, k] @ a[np.minimum(t[:, k] + 1, len(a) - 1)]
    return [ga, gb, ds.sum(0), c.T @ dh, dh.sum(0), f.T @ d, d.sum(keepdims=True)]


def fit(texts: list[bytes], y: np.ndarray, share: float, epochs: int = EPOCHS) -> Net:
    """Adam on mini-batches of similar length; then the bias is moved from the sample's share of label 1 to `share`."""
    net, r = fresh(), np.random.default_rng(3)
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    m, v, k = [np.zeros_like(p) for p in net.all()], [np.zeros_like(p) for p in net.all()], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        mixed = r.permutation(len(raw))
        for b in range(0, len(raw), BATCH):
            pick = mixed[b : b + BATCH]
            k += 1
            for p, g, pm, pv in zip(net.all(), gradients(net, [raw[i] for i in pick], y[pick]), m, v, strict=True):
                pm += 0.1 * (g - pm)
                pv += 0.001 * (g * g - pv)
                p -= rate * (pm / (1 - 0.9**k)) / (np.sqrt(pv / (1 - 0.999**k)) + 1e-7)
    logit = lambda x: np.log(x / (1 - x))
    net.b3 += np.float32(logit(share) - logit(y.mean()))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Net | float:
    """A network, or one probability where the labels show one class only."""
    seen = labels.filter(f"doc_id is not null and {label} in (0, 1)")
    n, ones = seen.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    got = labelled_sample(docs, labels, label, rows, chars, per_label=True).orderBy("doc_id").toArrow()
    y = got.column("y").to_numpy().astype(np.float32)
    share = (ones + 1) / (n + 2)
    if not len(y) or y.min() == y.max():
        return share
    return fit([t.encode() for t in got.column("text").to_pylist()], y, share)


def quality_score(net: Net | float):
    """Column function from a text to its probability of label 1; one pass, no shuffle."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        if isinstance(net, float):
            return pa.array(np.full(len(text), net))
        at, data = byte_view(text)
        logits, lo = np.zeros(len(text)), 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE, side="right")) - 1)
            hi = min(hi, lo + SLICE // SEGMENT)
            texts = [data[at[i] : at[i + 1]] for i in range(lo, hi)]
            logits[lo:hi] = score_long(net, texts[0]) if len(texts[0]) > SLICE else score_texts(net, texts)
            lo = hi
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -60, 60))))

    return score


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit_quality(docs, labels.filter(~fold("doc_id", 3, 1)))
    scored = docs.select("doc_id", quality_score(net)("text").alias("score"))
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
