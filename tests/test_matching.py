"""Similarity joins against brute force over all pairs."""

import random
from difflib import SequenceMatcher

from ledgerloom.operators import similarity as sim
from ledgerloom.operators import vendors as vd


def _texts(rng, n):
    return ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))).strip() or "a" for _ in range(n)]


def test_ratio_candidates_miss_nothing(spark):
    rng = random.Random(2)
    a, b = sorted(set(_texts(rng, 90))), sorted(set(_texts(rng, 90)))
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    got = {(r.a, r.b) for r in sim.ratio_candidates(left, right, "a", "b", 0.8).collect()}
    want = {(x, y) for x in a for y in b if SequenceMatcher(None, y, x).ratio() >= 0.8}
    assert want and want <= got


def test_token_set_candidates_miss_nothing(spark):
    rng = random.Random(4)
    words = ["north", "norh", "bay", "bays", "supply", "suply", "co", "market", "the"]
    make = lambda: sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(80)})
    a, b = make(), make()
    left, right = spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    got = {(r.a, r.b) for r in sim.token_set_candidates(left, right, "a", "b", 90.0).collect()}
    want = {(x, y) for x in a for y in b if sim._token_set(x, y) >= 90}
    assert want and want <= got


def _names(rng, n):
    """Shop names as statements print them: a few common words, own words, numbers, cities."""
    common = ["MARKET", "CAFE", "STORE", "SUPPLY", "INC", "LLC", "SERVICE", "AUTO", "GRILL", "THE", "HOUSE", "OF", "CENTER", "SHOP"]
    cities = ["HONOLULU", "SAN JOSE", "NEW YORK", "PORTLAND", "AUSTIN", "RENO"]
    syllables = ["KA", "LO", "MI", "TRA", "VEN", "SO", "BER", "TO", "NU", "SHI", "RO", "DEL", "PA", "GRE", "WIN", "HA", "CO", "LI"]
    own = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    made = set()
    while len(made) < n:
        parts = [own(), rng.choice([own(), rng.choice(common)]), rng.choice(common)] + ([rng.choice(cities)] if rng.random() < 0.3 else []) + ([f"#{rng.randint(1, 999)}"] if rng.random() < 0.3 else [])
        made.add(" ".join(parts))
    return sorted(made)


def test_few_pairs_of_many_names_become_candidates(spark):
    """2,000 names against 2,000, a tenth of them misspelt from the other side: under one pair in a hundred is scored."""
    rng = random.Random(12)
    b = _names(rng, 2000)
    a = _names(random.Random(13), 1800) + [x[:k] + x[k + 1 :] for x in rng.sample(b, 200) for k in [rng.randrange(1, len(x))]]
    left, right = spark.createDataFrame([(x,) for x in sorted(set(a))], "a string"), spark.createDataFrame([(x,) for x in b], "b string")
    got = {(r.a, r.b) for r in sim.ratio_candidates(left, right, "a", "b", 0.8).collect()}
    assert len(got) < 0.01 * len(set(a)) * len(b)
    some = rng.sample(sorted(set(a)), 60) + sorted(set(a) - set(_names(random.Random(13), 1800)))[:60]
    want = {(x, y) for x in some for y in b if 2 * min(len(x), len(y)) >= 0.8 * (len(x) + len(y)) and SequenceMatcher(None, y, x).ratio() >= 0.8}
    assert want and want <= got
    pairs = sim.token_set_candidates(left, right, "a", "b", 90.0).collect()
    assert len(pairs) < 0.01 * len(set(a)) * len(b)


def test_vendor_precedence_and_ties(spark):
    sheet = spark.createDataFrame([(0, "Acme", "Acme Tools;Tool Co"), (1, "Tool Shop", None), (2, " ", "x")], "row_no int, Vendor string, Aliases string")
    d = vd.build_vendor_dict(sheet, "row_no")
    assert {(r.vendor, r.norm) for r in d.collect()} == {("Acme", "ACME"), ("Acme", "ACME TOOLS"), ("Acme", "TOOL"), ("Tool Shop", "TOOL SHOP")}
    tx = spark.createDataFrame(
        [(1, "tool shop #9", ""), (2, "ACME TOOLS 12345", ""), (3, "acmee tools", ""), (4, "zzz", ""), (5, "transfer to checking 1", ""), (6, "x", "Jo")],
        "n int, description string, payee string",
    )
    rules = spark.createDataFrame([("transfer", "Short", 0), ("Transfer to checking", "Long", 1), ("TRANSFER TO CHECKING", "Late", 2)], "phrase string, vendor string, rule_no int")
    got = {r.n: r.vendor for r in vd.assign_vendor(tx, d, rules).collect()}
    assert got == {1: "Tool Shop", 2: "Acme", 3: "Acme", 4: "", 5: "Long", 6: "Jo"}


def test_contains_is_exact_with_and_without_the_table(spark):
    rng = random.Random(9)
    texts, terms = sorted(set(_texts(rng, 60))), sorted({t[:3] for t in _texts(rng, 40)})
    want = {(x, y) for x in texts for y in terms if y in x}
    left, right = spark.createDataFrame([(x,) for x in texts], "x string"), spark.createDataFrame([(y,) for y in terms], "y string")
    for part in (right, right.filter("length(y) >= 2")):
        keep = {r.y for r in part.collect()}
        got = {(r.x, r.y) for r in vd.contained_pairs(left, "x", part, "y").collect()}
        assert got == {p for p in want if p[1] in keep}


def test_contains_with_a_large_dictionary(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 7)))
    terms = sorted({f"{word()} {word()}" for _ in range(10_000)} | {"a", "bc", ""})
    texts = [f"{word()} {rng.choice(terms)} {word()}" for _ in range(300)]
    left, right = spark.createDataFrame([(x,) for x in texts], "x string"), spark.createDataFrame([(y,) for y in terms], "y string")
    got = {(r.x, r.y) for r in vd.contained_pairs(left, "x", right, "y").collect()}
    assert got == {(x, y) for x in texts for y in terms if y and y in x}
