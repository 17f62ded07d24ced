"""Operators 11, 12 and 13 against plain Python: audits of filters, line dedup, conversation repair."""

import hashlib
import random
import re
from fractions import Fraction
from itertools import permutations
from math import comb

import pytest
from helpers import CLASH, ODD, documents, no_documents, odd_documents

from ledgerloom.llm import op11_filter_audit as op11
from ledgerloom.llm import op12_line_dedup as op12
from ledgerloom.llm import op13_turn_repair as op13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Filter audit


@pytest.mark.parametrize("m", [2, 3, 5])
def test_weights_are_the_sum_over_all_orders(m):
    rng = random.Random(m)
    v = [0] + [rng.randrange(1000) for _ in range((1 << m) - 1)]
    sums = [0] * m
    for order in permutations(range(m)):
        s = 0
        for i in order:
            sums[i] += v[s | 1 << i] - v[s]
            s |= 1 << i
    assert [sum(w * x for w, x in zip(row, v, strict=True)) for row in op11.shapley_weights(m)] == sums


def test_shapley_is_the_weighted_least_squares_fit():
    """The values fit the coalitions better, under the kernel, than any shifted ones of the same sum."""
    m, rng = 4, random.Random(5)
    v = [0] + [rng.randrange(100) for _ in range(15)]
    values = [Fraction(sum(w * x for w, x in zip(row, v, strict=True)), 24) for row in op11.shapley_weights(m)]
    loss = lambda p: sum(Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) * (v[s] - sum(p[i] for i in range(m) if s >> i & 1)) ** 2 for s in range(1, 15))
    assert sum(values) == v[15]
    for i in range(m):
        for j in range(m):
            if i != j:
                moved = [x + (k == i) - (k == j) for k, x in enumerate(values)]
                assert loss(moved) > loss(values)


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    docs = []
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang, _ in rows:
        text = t or ""
        words = WORD.findall(text)
        fails = ""
        fails += "A" * (len(words) < 100)
        fails += "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (i is not None and i > least[text])
        docs.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part in sorted({d[0] for d in docs}):
        mine = [d for d in docs if d[0] == part]
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in mine)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(d[1] == f for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        total = {f: sum(s[4] for s in steps if s[1][s[2] - 1] == f) for f in "ABCDE"}
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(docs, labels):
    return op11.audit(op11.coalitions(op11.failure_counts(docs, labels), 5), "ABCDE")


def test_audit_matches_plain_python(spark):
    rng = random.Random(1)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [*ODD, "", None, long, long + " $", "A B C", " ".join(["w"] * 200), "#", "SHOUT " * 40]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", "", None]), "s") for _ in range(300)]
    marks = [(rng.choice([None, *range(60)]), rng.randrange(2), rng.choice([0, 1, None])) for _ in range(80)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id bigint, quality int, toxic int, part string")
    got = audited(documents(spark, rows), labels).select(*COLUMNS)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, marks)
    assert audited(no_documents(spark), labels).count() == 0
    assert audited(odd_documents(spark), labels.limit(0)).count() == 600 * 2


# Line dedup


def plain_lines(rows, min_chars, min_docs, keep):
    """(doc_id, n_lines, n_dropped, text) of rows in corpus order."""
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate({i: i + 32 for i in range(65, 91)})
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is not None, rows[r][0] or 0, r))
    docs_of, first = {}, {}
    for r in order:
        for p, line in enumerate((rows[r][1] or "").split("\n")):
            docs_of.setdefault(key(line), set()).add(r)
            first.setdefault(key(line), (r, p))
    out = []
    for r, row in enumerate(rows):
        lines = (row[1] or "").split("\n")
        stay = [x for p, x in enumerate(lines) if len(key(x)) < min_chars or len(docs_of[key(x)]) < min_docs or (keep == "first" and first[key(x)] == (r, p))]
        out.append((row[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_chars", "min_docs", "keep"), [(1, 10, "none"), (3, 2, "first"), (0, 2, "none"), (0, 1, "first")])
def test_lines_match_plain_python(spark, tmp_path, min_chars, min_docs, keep):
    rng = random.Random(3)
    pool = ["", " ", "a", "Menu ", "\tmenu", "Home | About", "é", "É", "x ", "x", "one", "\x0b", "a\rb"]
    rows = [(i % 150 if i % 7 else None, "\n".join(rng.choice([*pool, f"line {i}", f"own {i // 2}"]) for _ in range(rng.choice([1, 2, 5, 200]))), "en", "s") for i in range(200)]
    rows += [(500, None, "en", "s"), (501, "", "en", "s"), (502, "\n" * 70, "en", "s"), (502, "\n" * 70, "en", "s"), (503, "\n".join(["menu"] * 500), "en", "s")]
    documents(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    marked = op12.mark_lines(spark.read.parquet(str(tmp_path / "d")), min_chars, min_docs, keep).collect()
    got = []
    for r in marked:
        bits = {w.word: w.bits for w in r.bitmap or []}
        lines = (r.doc.text or "").split("\n")
        assert all(b != -1 for b in bits.values()) and list(bits) == sorted(bits)
        stay = [x for p, x in enumerate(lines) if bits.get(p // 64, -1) >> (p % 64) & 1]
        got.append((r.doc.doc_id, r.n_lines, r.n_dropped, "\n".join(stay)))
        assert r.doc.h == CLASH["h"] and r.doc.row_id == CLASH["row_id"]
    assert sorted(got, key=str) == plain_lines(rows, min_chars, min_docs, keep)


def test_kept_text_from_the_bitmap(spark):
    rows = [(i, "\n".join(["Menu", f"body {i}", "", "menu"] * (1 + 40 * (i % 3))), "en", "s") for i in range(12)]
    marked = op12.mark_lines(documents(spark, rows, clash=False))
    got = {r[0]: r[1] for r in marked.select("doc.doc_id", op12.kept_text(op12.F.col("doc.text"), op12.F.col("bitmap"))).collect()}
    assert got == {i: t for i, _, _, t in plain_lines(rows, 1, 10, "none")} and "body 3" in got[3] and "enu" not in got[3]
    assert op12.mark_lines(no_documents(spark)).count() == 0
    with pytest.raises(ValueError, match="keep"):
        op12.keep_bitmaps(documents(spark, rows), keep="last")


# Conversation repair


def cheapest(letters):
    """(cost, audit) by dynamic programming over strings; letters as in the lattice."""
    best = {op13.START: (0, "")}

    def inserted(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                to = (c + 2, a + "I")
                if op13.EXPECTED[s] not in states or to < states[op13.EXPECTED[s]]:
                    states[op13.EXPECTED[s]] = to
        return states

    for x in letters:
        after = {}
        for s, (c, a) in inserted(best).items():
            moves = [(s, 3, "D")]
            if x != "-":
                short = x.isupper()
                kept = op13.keep_to(s, x.lower())
                moves += [(kept, short, "K")] if kept is not None else []
                moves += [(op13.EXPECTED[s], 2 + short, "R")]
            for to, cost, edit in moves:
                after[to] = min(after.get(to, (10**9, "")), (c + cost, a + edit))
        best = after
    return min((c + op13.ENDING[s][0], a + op13.ENDING[s][1]) for s, (c, a) in best.items())


def test_auction_against_dynamic_programming():
    rng = random.Random(11)
    for n in [*range(1, 12)] * 25 + [60] * 10:
        rows = "".join(rng.choice("suaxSUAX-") if rng.random() < 0.5 else "ua"[k % 2] for k in range(n))
        cost, audit = cheapest(rows)
        way = op13.traces(rows, True, True, tuple(op13.ENDING[s][0] for s in range(4)))[op13.START]
        assert (way[0], way[2]) == (cost, audit), rows
        assert op13.crossing(rows, True, True)[0] == cost


def plain_repair(rows):
    """Report and repaired lines of (turn, role, text) rows."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    tie = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
    rows.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1], tie(*y[1:])))
    seen, letters, counts = set(), "", [0, 0, 0]
    for _, r, x in rows:
        initial = r[:1] if r[:1] in ("s", "u", "a") else "x"
        words = WORD.findall(x)
        if not words:
            counts[0] += 1
            letters += "-"
        elif (r, x) in seen:
            counts[1] += 1
            letters += "-"
        elif words[-1][-1] not in ".!?":
            counts[2] += 1
            letters += initial.upper()
        else:
            letters += initial
        seen.add((r, x))
    initials = [r[:1] if r[:1] in ("s", "u", "a") else "x" for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = cheapest(letters)
    lines, state, k = [], op13.START, 0
    for edit in audit:
        if edit == "I":
            state = op13.EXPECTED[state]
            lines.append(f"{op13.INSERTED[state]}:")
            continue
        _, r, x = rows[k]
        k += 1
        if edit == "R":
            state = op13.EXPECTED[state]
            lines.append(f"{op13.INSERTED[state]}:{x}")
        elif edit == "K":
            state = op13.BY_INITIAL[r[:1]]
            lines.append(f"{r}:{x}")
    assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in lines))
    return (gaps, *counts, illegal, cost, audit), lines


def talk(rng, n, wild):
    rows = []
    for k in range(n):
        role = rng.choice(["user", "assistant", "system", "tool", "", None, "User"]) if rng.random() < wild else ("user", "assistant")[k % 2]
        text = rng.choice([f"Turn {k}.", f"Turn {k}", "Yes.", "yes", "", " \n", None, "é?", "x" * 2000 + "!"]) if rng.random() < wild else f"This is {k}."
        rows.append((rng.choice([None, k, k + 1, k * 2]) if rng.random() < 0.2 else k, role, text))
    return rows


@pytest.mark.parametrize("chunk", [3, 64])
def test_repair_matches_plain_python(spark, chunk):
    """Conversations longer than a chunk, a hot one, nulls, ties and repeated rows; the chunk size must not show."""
    rng = random.Random(chunk)
    convs = {c: talk(rng, rng.choice([1, 2, 3, 7, 20]), 0.5) for c in [None, *range(40)]}
    convs[90] = talk(rng, 700, 0.2)
    convs[91] = [(1, "user", "Same.")] * 100
    convs[92] = [(k, "assistant", f"t{k}") for k in range(130)]
    data = [(c, t, r, x, 7, "seq") for c, rows in convs.items() for t, r, x in rows]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, seq int, tie string")
    marked, report = op13.repair(frame, chunk)
    got = {r.conv_id: tuple(r)[1:] for r in report.collect()}
    want = {c: plain_repair(rows) for c, rows in convs.items()}
    assert got == {c: w[0] for c, w in want.items()}
    turns = {}
    for r in op13.repaired_turns(frame, chunk).collect():
        turns.setdefault(r.conv_id, []).append((r.pos, f"{r.role}:{r.text}"))
    assert {c: [x for _, x in sorted(v)] for c, v in turns.items()} == {c: w[1] for c, w in want.items() if w[1]}


def test_repair_of_the_query_on_odd_tables(spark, tmp_path):
    """Damage, dropped conversations, null keys, clashing columns and empty tables through the query itself."""
    rng = random.Random(2)
    rows = [(c, *r) for c in [None, *range(60)] for r in talk(rng, rng.choice([1, 1, 3, 9]), 0.4)]
    schema = "conv_id bigint, turn bigint, role string, text string, seq int, cost long, audit string"
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op13.op13_turn_repair(spark, str(tmp_path)).collect()}
    import zlib

    left = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(hit, x)
        left[c] += [(t, "user" if hit == 4 else r, x)] * {0: 0, 3: 2}.get(hit, 1)
    assert set(got) == set(left) and any(not v for v in left.values())
    for c, mine in left.items():
        facts, lines = plain_repair(mine) if mine else ((0, 0, 0, 0, 0, 0, ""), [])
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == facts
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert op13.op13_turn_repair(spark, str(tmp_path / "none")).count() == 0
