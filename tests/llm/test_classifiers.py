"""Operators 2, 3, 4 and 8: gradients, exact neighbours and rules against plain code; held-out results on the given tables."""

import re

import numpy as np
import pytest
from helpers import ODD, PLAIN, documents, no_documents, odd_documents
from pyspark.sql import functions as F

from ledgerloom.llm import op2_byte_cnn as op2
from ledgerloom.llm import op3_url_trees as op3
from ledgerloom.llm import op4_word_backoff as op4
from ledgerloom.llm import op8_nearest_toxic as op8
from ledgerloom.llm.common import fold, table

SF = "/root/testdata/sf0.01"


def test_network_gradients():
    net = op2.fresh()
    for p in net.all():
        p[...] = p + np.random.default_rng(1).standard_normal(p.shape).astype(np.float32) * 0.05
    texts = [np.frombuffer(t.encode(), np.uint8) for t in (PLAIN * 9, "SHOUT!! " * 100, "short")]
    y = np.array([1, 0, 1], np.float32)

    def loss():
        z = op2.score_texts(net, texts).astype(float)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for p, g in zip(net.all(), op2.gradients(net, texts, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, e = p[at].copy(), 2e-3
        p[at] = keep + e
        up = loss()
        p[at] = keep - e
        down = loss()
        p[at] = keep
        assert (up - down) / (2 * e) == pytest.approx(g[at], rel=0.15, abs=2e-3)


def test_long_texts_score_as_short_ones(monkeypatch):
    net = op2.fresh()
    text = np.frombuffer(("".join(f"Word {i}, " for i in range(3000))).encode(), np.uint8)
    monkeypatch.setattr(op2, "SLICE", 2048)
    assert op2.score_long(net, text) == pytest.approx(float(op2.score_texts(net, [text])[0]), abs=1e-3)


def test_quality_on_held_out_rows(spark):
    labels = table(spark, SF, "labels")
    rows = op2.op2_byte_cnn(spark, SF).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert (good.predicted == 1).mean() > 0.93 and (bad.predicted == 0).mean() > 0.6
    assert rows.score.between(0, 1).all()


def test_quality_without_labels_or_rows(spark):
    docs, none = odd_documents(spark), spark.createDataFrame([], "doc_id bigint, quality int")
    assert op2.fit_quality(docs, none) == 0.5
    one = spark.createDataFrame([(1, 1), (7, 1), (None, 0), (8, None)], "doc_id bigint, quality int")
    share = op2.fit_quality(docs, one)
    assert {r.s for r in docs.select(op2.quality_score(share)("text").alias("s")).collect()} == {0.75}
    net = op2.fit([b"good text. " * 30, b"BAD!! " * 40], np.array([1, 0], np.float32), 0.5, epochs=2)
    scored = docs.withColumn("score", op2.quality_score(net)("text"))
    assert scored.count() == len(ODD) + 3 and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert len({r.score for r in scored.filter(F.col("text") == PLAIN).collect()}) == 1
    assert no_documents(spark).select(op2.quality_score(net)("text")).count() == 0


def test_nearest_examples_are_exact():
    r = np.random.default_rng(3)
    terms = [f"t{i}" for i in range(60)]
    examples = [(i, int(r.integers(0, 2)), {int(t): int(r.integers(1, 4)) for t in r.integers(0, 60, int(r.integers(0, 6)))}) for i in range(400)]
    idf = r.random(60) + 0.5
    index = op8.build_index(terms, idf, examples)
    full = np.zeros((len(index.ids), 60))
    for t, (docs, vals) in enumerate(index.posts):
        full[docs, t] = vals
    for _ in range(60):
        at, w = op8.weights({int(t): 1 for t in r.integers(0, 60, 4)}, idf)
        sims = np.round(full[:, at] @ w, 12)
        want = [p for p in np.lexsort((np.arange(len(sims)), -sims)) if sims[p] > 0][:15]
        best, got = index.nearest(at, w, 15)
        assert best.tolist() == want and np.allclose(got, sims[want])
        kept = sum(examples_y * s for examples_y, s in zip(index.y[want], sims[want], strict=True)) + op8.PRIOR_VOTES * index.share
        assert index.score({int(t): 1 for t in at})[0] == pytest.approx(kept / (sims[want].sum() + op8.PRIOR_VOTES))


def test_vocabulary_counts_terms():
    v = op8.Vocabulary(["idiot", "vequ~", "lowei~", "abcdef~"])
    text = "Idiot idiots; vequance vequ VEQUA loweient abcdef abcdefg"
    full = op8.terms_of(text)
    assert v.counts(text) == {i: full[t] for t, i in v.at.items() if full[t]}
    assert v.counts(None) == v.counts("") == v.counts("nothing here") == {}


def test_toxicity_on_held_out_rows(spark):
    rows = op8.op8_nearest_toxic(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (bad.predicted == 1).mean() > 0.6 and (good.predicted == 0).mean() > 0.98


def test_toxicity_frequencies_and_odd_rows(spark):
    docs = odd_documents(spark)
    n, rows = op8._document_frequency(docs, ["fox", "one", "quick~", "quic~"])
    assert n.tolist() == [6, 1, 0, 6] and rows == len(ODD) + 3
    empty = op8.fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r.s for r in docs.select(op8.toxicity_score(empty)("text").alias("s")).collect()} == {0.0}
    assert no_documents(spark).select(op8.toxicity_evidence(empty)("text")).count() == 0


def test_languages(spark):
    rows = op4.op4_word_backoff(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()


def test_language_backoff_and_odd_rows(spark):
    model = op4.Model(["a", "b"], [{"known": 0}, {"z": 1}, {"yz": 2}, {}, {}, {"^abcd": 3, "abcde": 4}], np.array([[0.0, 1], [5, 0], [6, 0], [1, 2], [3, 4]]))
    assert model.word_score("known").tolist() == [0, 1]
    assert model.word_score("abcde").tolist() == [2, 3]
    assert model.word_score("xyz").tolist() == [6, 0] and model.word_score("qz").tolist() == [5, 0] and model.word_score("q").tolist() == [0, 0]
    docs = odd_documents(spark)
    got = op4.identify(docs, op4.fit_languages(docs)).collect()
    assert len(got) == len(ODD) + 3 and {r.lang_pred for r in got} == {"en", "und"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    nothing = op4.fit_languages(no_documents(spark))
    assert {r.lang_pred for r in op4.identify(docs, nothing).collect()} == {"und"}
    digits = documents(spark, [(1, "12 ½ ² !", "en", "s"), (2, "naïve ²", "en", "s")])
    assert [op4.word_list(r.text) for r in digits.orderBy("doc_id").collect()] == [[], ["naïve", "²"][:1]]


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net/de/", "x://net/", "http://net", "http://sub.net?q=/", "ftp://example.com/de/1",
    "http://notexample.com/de/", "http://a.example.com/deutsch/de/", "http://x.org/fr/é", "http://x.org/FR/", "http://ÀB.org/fr/\n://y", "://host/path", "http://example.net/en/",
]


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(r, v) for r, v in op3.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=lambda f: len(f[0])) if fits else (None, None)


def test_url_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "html", "h", 1.0) for i, u in enumerate([*URLS, URLS[3]])], "page_id bigint, url string, html string, host string, label double")
    got = {r.page_id: r for r in op3.filter_urls(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, (rule, verdict) = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert op3.filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in op3.filter_urls(pages.filter("url = 'x'")).collect()} <= {"allow"}
    bare = spark.createDataFrame([(1, "http://unruled.com/")], "page_id bigint, url string")
    assert op3.filter_urls(bare).first().verdict == "allow"


def test_url_trees_learn_the_labelled(spark):
    rows = op3.op3_url_trees(spark, SF).filter("rule is not null").toPandas()
    assert ((rows.block_score >= 0.5) == (rows.verdict == "block")).mean() > 0.9


def test_entropy_of_characters(spark):
    got = spark.createDataFrame([("aabb",), ("a",), ("",), ("abcd",)], "u string").select(op3.entropy(F.col("u")).alias("e")).collect()
    assert [round(r.e, 6) for r in got] == [1.0, 0.0, 0.0, 2.0]


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 3, 1).alias("f")).collect()
    assert all(r.f == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
