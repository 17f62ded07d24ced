"""Operators 1, 6 and 7 against SQL and plain Python; the pipeline stage by stage."""

import base64
import hashlib

import pytest
from differential import compare, connect
from helpers import ODD, PLAIN, documents, no_documents, odd_documents

import corpus_pipeline
from ledgerloom.llm import op1_snapshots as op1
from ledgerloom.llm import op6_fair_queue as op6
from ledgerloom.llm import op7_warc as op7
from ledgerloom.llm import queries as q
from ledgerloom.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, q.queries()[name], q.oracle_sql()[name], SF) is None


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 1100)}) == 1
    assert len(set(got.values())) == 2 and 5000 not in got
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def chat(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, place int, h string")


def plain_chats(rows):
    convs = {}
    for c, t, r, x in set(rows):
        if c is not None:
            convs.setdefault(c, []).append((t is None, t or 0, r, x))
    seqs = {c: tuple(x[2:] for x in sorted(v, key=lambda x: x[:2])) for c, v in convs.items()}
    proper = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    kept = {}
    for c, s in sorted(seqs.items()):
        if s not in proper:
            kept.setdefault(s, []).append(c)
    return sorted((c[0], len(s), len(c), "".join(f"<|im_start|>{r or 'unknown'}\n{(x or '').replace('<|im_', '<| im_')}<|im_end|>\n" for r, x in s)) for s, c in kept.items())


def test_snapshots_collapse(spark):
    long = [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(700)]
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo"),
        (4, 0, "user", "hi"), (4, 1, "assistant", None), (5, 3, None, "<|im_end|>"), (5, None, "user", "last"), (6, 0, "user", ""), (7, 0, "user", None),
        (None, 0, "user", "lost"), *long, *[(8, *r[1:]) for r in long[:400]],
    ]
    got = {}
    for r in op1.format_chats(chat(spark, rows)).collect():
        got.setdefault((r.conv_id, r.n_turns, r.n_copies), {})[r.part] = r.text
    assert sorted((*k, "".join(v[p] for p in sorted(v))) for k, v in got.items()) == plain_chats(rows)
    assert max(len(v) for v in got.values()) == 11
    assert op1.format_chats(chat(spark, [])).count() == 0


def test_mixture_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 40), "en", f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(900, None, "en", "tiny"), (901, "a b c", "en", "tiny"), (901, "a b c", "en", "tiny")]
    found = op6.mixture(documents(spark, rows)).toPandas()
    assert len(found) == len(rows) and (found.taken <= 3 * found["size"]).all()
    by = found.groupby(found.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert ((by.taken - by.target).abs() <= 2).all() and (by.target <= 3 * by["size"]).all()
    assert abs(by.target.sum() - found["size"].sum()) < 1e-6
    again = op6.mixture(documents(spark, list(reversed(rows)))).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, again[key].fillna(-1).to_numpy().tolist())) == sorted(map(tuple, found[key].fillna(-1).to_numpy().tolist()))
    order = op6.mixed_order(documents(spark, rows)).collect()
    assert [r.finish for r in order] == sorted(r.finish for r in order)
    at = 0
    for r in order:
        assert r.position == at
        at += r.words
    assert op6.mixture(no_documents(spark)).count() == 0
    assert op6.mixture(odd_documents(spark)).count() == len(ODD) + 3


INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99:X:0:0>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", [None, 37, 211, 1500])
def test_archives_round_trip(spark, tmp_path, split):
    rows = [(1, "http://a", "x"), (2, "http://b", INNER * 3 + "tail"), (3, None, None), (4, "u", ""), (4, "u", ""), (5, "http://c d\r\n", "ünïcödé"), (6, "q", "WARC/1.0\r\n")]
    rows += [(None, "n", "x"), (7, "z", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n"), (8, "z", INNER), (8, "z", INNER), (9, "y", INNER)]
    rows += [(100 + i, f"h{i}", "p" * (i * 7) + INNER * (i % 4)) for i in range(40)]
    pages = spark.createDataFrame([(*r, "k", 5) for r in rows], "page_id bigint, url string, html string, digest string, copies int").repartition(3)
    op7.write_warc(pages, f"{tmp_path}/warc")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        found = op7.read_warc(spark, f"{tmp_path}/warc")
        got = sorted(str(tuple(r)) for r in found.select(*fields).collect())
        assert found.filter("payload_digest != header_digest").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    want, first = [], {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append(str((i, len(raw), d, "revisit" if d in first else "response", first.get(d))))
        first.setdefault(d, i)
    assert got == sorted(want)


def test_archives_read_again_with_other_splits(spark, tmp_path):
    """Payloads with a magic are whole when the splits change between the two reads."""
    rows = [(i, f"h{i}", "p" * (i * 7) + INNER * (i % 4) + f"end {i % 10}") for i in range(40)]
    op7.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), f"{tmp_path}/warc")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        found = op7.read_warc(spark, f"{tmp_path}/warc")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in found.collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == [(i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows]


def test_archives_of_small_payloads_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "same"), (2, "b", "same"), (3, "c", "longer same"), (4, "d", "longer same")], "page_id bigint, url string, html string")
    op7.write_warc(pages, f"{tmp_path}/warc", min_bytes=5)
    assert sorted((r.page_id, r.record_type) for r in op7.read_warc(spark, f"{tmp_path}/warc").collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    op7.write_warc(pages.limit(0), f"{tmp_path}/none")
    assert op7.read_warc(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Every stage on its own input: what it drops is what its operator says, the columns stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = documents(spark, [(90001, PLAIN * 3, "en", "s"), (90001, PLAIN * 3, "en", "s"), (90002, PLAIN * 3, "en", "t"), (None, None, None, None)], clash=False)
    path = f"{tmp_path}/docs"
    docs.unionByName(extra).write.parquet(path)
    docs = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= before and len(after) > 100
        if name == "near_duplicates":
            assert after.count(90001) + after.count(90002) <= 1
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).toPandas()
    assert len(mixed) and (mixed.taken > 0).all() and set(mixed.doc_id.dropna()) <= set(after)


def test_pipeline_drops_the_same_rows_when_splits_change(spark, tmp_path):
    """The rows to drop are found with one way of cutting the files and removed with another."""
    lone = [" ".join(f"{w}{i}" for w in PLAIN.split()) for i in range(40)]
    rows = [(i, lone[i % 30] if i < 60 else lone[i - 30], "en", "s") for i in range(70)]
    bench = spark.createDataFrame([(1, lone[5]), (2, lone[38])], "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    documents(spark, rows, clash=False).repartition(7, "doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    frames = (docs, docs.unionByName(docs.filter("doc_id is null")))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for frame in frames:
            for k, v in keep.items():
                spark.conf.set(k, v)
            single = corpus_pipeline.drop_near_duplicates(spark, frame, f"{tmp_path}/sf")
            clean = corpus_pipeline.drop_contaminated(spark, frame, f"{tmp_path}/sf")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert sorted(r.doc_id for r in single.collect()) == [*range(30), *range(60, 70)]
            assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(70) if i not in (5, 35, 68)]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_pipeline_runs_and_repeats(spark):
    one, two = (sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "taken").collect())) for _ in range(2))
    assert one == two


def test_pipeline_stages_on_an_empty_table(spark):
    """No documents, columns whose names the operators use inside: every stage gives none and keeps the columns but row_id."""
    docs = no_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert [c for c in docs.columns if c != "row_id"] == [c for c in out.columns if c != "row_id"] and out.count() == 0
    assert corpus_pipeline.mix_sources(spark, docs, SF).count() == 0
