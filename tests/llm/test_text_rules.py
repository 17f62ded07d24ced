"""Operators 5, 9 and 10 against plain Python on small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from helpers import ODD, PLAIN, documents, no_documents, odd_documents

from ledgerloom.llm import op9_setsketch as op9
from ledgerloom.llm import op10_compression_bands as op10
from ledgerloom.llm import words as W
from ledgerloom.llm.op5_winnowing import contamination, fingerprints
from ledgerloom.llm.op10_compression_bands import compression_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_cross_blocks_and_texts(monkeypatch):
    texts = ["a bc", "", "dé f\n", "g" * 50 + " h", "ij " * 40, "kl"]
    at, data = W.byte_view(pa.array(texts))
    whole = [w for w in W.words(at, data, W.NOT_SPACE, lower=False)]
    monkeypatch.setattr(W, "BLOCK", 7)
    for got in ([*W.words(at, data, W.NOT_SPACE, lower=False)], whole):
        found = {}
        for w in got:
            for i in range(w.lo, w.hi):
                a, b = w.first[i - w.lo], w.first[i - w.lo + 1]
                found[i] = ([data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)], w.hash[a:b].tolist())
        assert [found[i][0] for i in range(len(texts))] == [SPACED.findall(t) for t in texts]
        assert [found[i][1] for i in range(len(texts))] == [h for w in whole for h in (w.hash[w.first[k] : w.first[k + 1]].tolist() for k in range(w.hi - w.lo))]


def test_winnowing_guarantee():
    r = np.random.default_rng(1)
    shared = r.integers(0, 1 << 60, 10, dtype=np.uint64)
    for _ in range(50):
        a = np.concatenate([r.integers(0, 1 << 60, 7, dtype=np.uint64), shared, r.integers(0, 1 << 60, 5, dtype=np.uint64)])
        assert fingerprints(shared, 10)[0] == fingerprints(a, 10)[7]


def plain_hits(texts, items, window=10):
    wins = {}
    for k, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for t in texts:
        w = ALNUM.findall((t or "").translate(LOW))
        hit, got = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    got |= k
        ids = sorted(str(x) for x in got if x is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_matches_brute_force(spark):
    base = " ".join(f"q{i}" for i in range(30))
    texts = [*ODD, base, f"zz {base[:60]} yy", " ".join(f"q{i}" for i in range(5, 15)) + "!", " ".join(f"q{i}" for i in range(5, 14)), "Short ITEM", "a short item here", "u v"]
    items = [(1, base), (2, base.upper()), (20, PLAIN), (3, None), (4, ""), (5, "short item"), (None, "u v"), (1, "zz q0")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, bench).collect()}
    assert [got[i] for i in range(len(texts))] == plain_hits(texts, items)
    assert contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert contamination(no_documents(spark), bench).count() == 0
    assert contamination(odd_documents(spark), bench).count() == len(ODD) + 3


def shingles(t, size):
    w = SPACED.findall((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_components(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return Counter((rows[i][0], len(sets[i]), low.get(find(i))) for i in range(len(rows)))


def test_near_duplicates_match_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, PLAIN), (50, None), (9, ODD[9]), (7, PLAIN)]
    # drifting copies: a chain whose ends are far apart, and stars around one text
    for start in range(6):
        w = [f"k{x}" for x in r.integers(0, 400, 120 + 10 * start)]
        for _ in range(25):
            at = int(r.integers(0, len(w)))
            w = w[:at] + [f"m{int(r.integers(0, 9999))}"] + w[at + 1 :] if start % 2 else w
            v = list(w)
            for at in r.integers(0, len(v), int(r.integers(0, 4))).tolist():
                v[at] = f"n{int(r.integers(0, 9999))}"
            rows.append((1000 + len(rows), " ".join(v)))
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    for size, percent in ((3, 85), (5, 80)):
        found = op9.near_duplicates(docs, size, percent).collect()
        assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in found) == plain_components(rows, size, percent)
        groups = Counter()
        for x in found:
            groups[x.component_id, x.n_shingles == 0] += x.keeper
        assert all(n == 1 for (c, empty), n in groups.items() if c is not None and not empty)
    assert op9.near_duplicates(no_documents(spark)).count() == 0


def test_no_link_at_the_threshold_is_lost(spark):
    """2,400 texts whose similarities lie around the threshold; families share common words but no shingle at random."""
    r = np.random.default_rng(8)
    rows = []
    for family in range(600):
        w = [f"c{int(x)}" if x < 5 else f"f{family}x{int(x)}" for x in r.integers(0, 60, 70)]
        for copy in range(4):
            v = list(w)
            for at in r.integers(0, len(v), copy + int(r.integers(0, 3))).tolist():
                v[at] = f"n{family}y{int(r.integers(0, 9))}"
            rows.append((len(rows), " ".join(v)))
    for size, percent in ((3, 85), (5, 80)):
        want = Counter()
        for at in range(0, len(rows), 4):
            want += plain_components(rows[at : at + 4], size, percent)
        found = op9.near_duplicates(documents(spark, [(i, t, "en", "s") for i, t in rows]), size, percent).collect()
        assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in found) == want
        assert 600 < len({x.component_id for x in found}) < 2300


def test_bands_follow_from_the_threshold():
    for percent in (80, 85, 95):
        # plain minima agree as often as the sets are similar, registers a little more often
        assert op9.MISS / 2 < (1 - (percent / 100) ** op9.ROWS) ** op9.bands_for(percent) < 4 * op9.MISS
    with pytest.raises(ValueError, match="registers"):
        op9.bands_for(50)


def test_sketches_estimate_and_merge():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    for share in (0.5, 0.85, 0.95):
        k = int(2000 * 2 * share / (1 + share))
        u, v = a, np.concatenate([a[:k], b[k:]])
        ru, rv = (op9.registers(op9.minima(W.mix(x), np.array([0]), 150)) for x in (u, v))
        got = op9.joint_estimate(ru, rv, np.array([2000]), np.array([2000]))[0]
        assert abs(got - share) < 0.17
        both = op9.registers(op9.minima(W.mix(np.union1d(u, v)), np.array([0]), 150))
        assert (both == np.maximum(ru, rv)).all()


def test_both_ends_of_a_text_are_judged(spark):
    """Prose with a tail or a head of noise or of one phrase is rejected, whichever comes first; prose alone stays."""
    r = np.random.default_rng(6)
    vocabulary = ["".join(chr(97 + int(x)) for x in r.integers(0, 26, int(n))) for n in r.integers(2, 9, 900)]
    prose = " ".join(vocabulary[int(900 * x**2)] for x in r.random(3000))
    noise = " ".join("".join(chr(33 + int(x)) for x in r.integers(0, 93, 7)) for _ in range(400))
    phrase = "buy it now " * 400
    rows = [prose[:4500], prose[:2048] + noise[:1950], noise[:1950] + prose[:2048], prose[:2048] + phrase[:1950], phrase[:1950] + prose[:2048], prose[:1500]]
    got = {x.doc_id: x for x in compression_rules(documents(spark, [(i, t, "en", "s") for i, t in enumerate(rows)])).collect()}
    assert [got[i].bad_chunks for i in range(6)] == [0, 1, 1, 1, 1, 0]
    assert [got[i].kept for i in range(6)] == [True, False, False, False, False, True]
    assert not any(got[i].base_failed for i in (0, 1, 2, 5))


def test_compression_rules_match_plain_counts(spark):
    noise = "".join(chr(33 + x) for x in np.random.default_rng(0).integers(0, 90, 4000)) + " a b" * 20
    texts = [*ODD, noise, "spam and eggs " * 400, "a #b $c\nx\n\nx\n \nx " + PLAIN]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in compression_rules(docs).collect()}
    for i, t in enumerate(texts):
        w = SPACED.findall(t or "")
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if SPACED.search(x)]
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (failed and r.kept)
    assert got[7].kept and not got[len(ODD)].kept and not got[len(ODD) + 1].kept
    # the verdict itself, by plain calls of the compressor
    size = lambda b: len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(b))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        if not raw:
            continue
        low, high, least, most, share = [b[1:] for b in op10.BANDS if len(raw) >= b[0]][-1]
        chunks = [raw[a : a + 2048] for a in range(0, len(raw) - 2047, 2048)] + ([raw[-2048:]] if len(raw) > 2048 and len(raw) % 2048 else [])
        bad = sum(not least <= size(c) / 2048 <= most for c in chunks)
        fits = low <= size(raw) / len(raw) <= high and (not chunks or bad / len(chunks) < share)
        assert (got[i].kept, got[i].bad_chunks, got[i].n_chunks) == (not got[i].base_failed and fits, bad, len(chunks))
    assert compression_rules(no_documents(spark)).count() == 0
    assert compression_rules(odd_documents(spark)).count() == len(ODD) + 3
