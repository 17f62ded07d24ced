"""Sequential definitions of the matching rules against the distributed ones."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import reconcile as rc


def test_returns_cancel_latest_unused_payment(spark):
    rng = random.Random(11)
    rows = []
    for n in range(400):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 25))
        begun = None if rng.random() < 0.3 else day - dt.timedelta(days=rng.randint(0, 3))
        status = rng.choice(["Settled", "Scheduled", "Returned"])
        rows.append((rng.randint(0, 3), "p", n, day, begun, Decimal(rng.randint(1, 4)), status))
    df = spark.createDataFrame(rows, "company_id int, period string, row_no int, settlement_date date, initiation_date date, amount decimal(18,2), status string")
    effective, returns = rc.cancel_returned_payments(df)
    got = {r.row_no: r.cancelled_row for r in returns.collect()}
    early, late = dt.date.min, dt.date.max
    used, want = set(), {}
    for r in sorted((r for r in rows if r[6] == "Returned"), key=lambda r: (r[3], r[4] or late, r[2])):
        fits = [p for p in rows if p[6] != "Returned" and p[0] == r[0] and p[5] == r[5] and p[3] <= r[3] and p[2] not in used]
        best = max(fits, key=lambda p: (p[3], p[4] or early, p[2]), default=None)
        want[r[2]] = best and best[2]
        if best:
            used.add(best[2])
    assert Counter(v is None for v in got.values()) == Counter(v is None for v in want.values())
    assert {v for v in got.values() if v is not None} == used
    assert {r.row_no for r in effective.collect()} == {r[2] for r in rows if r[6] != "Returned"} - used


def _split_case(rng, n):
    ws, pay = [], []
    for i in range(n):
        a, b = rng.randint(1, 6), rng.randint(1, 6)
        ws.append((rng.randint(0, 2), "q", i, dt.date(2024, 1, 1), Decimal(a + b), Decimal(a), Decimal(b)))
    for i in range(int(n * 1.3)):
        pay.append((rng.randint(0, 2), "q", i, dt.date(2024, 1, 2), Decimal(rng.randint(1, 12))))
    return ws, pay


def _split_want(ws, pay):
    pool = Counter((p[0], p[4]) for p in pay)
    direct, split = set(), set()
    for r in ws:
        if pool[r[0], r[4]] > 0:
            pool[r[0], r[4]] -= 1
            direct.add((r[0], r[2]))
    for r in ws:
        if (r[0], r[2]) in direct:
            continue
        need = Counter([(r[0], r[5]), (r[0], r[6])])
        if all(pool[k] >= v for k, v in need.items()):
            pool.subtract(need)
            split.add((r[0], r[2]))
    return direct, split


def test_split_pairs_streamed_and_in_rounds(spark):
    ws, pay = _split_case(random.Random(5), 240)
    w = spark.createDataFrame(ws, "company_id int, period string, row_no int, date date, edd_total decimal(18,2), ui_ett decimal(18,2), p_i decimal(18,2)")
    p = spark.createDataFrame(pay, "company_id int, period string, row_no int, pay_date date, amount decimal(18,2)")
    direct, split = _split_want(ws, pay)
    d = rc.match_direct(w, p)
    assert {(r.company_id, r.row_no) for r in d.filter("direct").collect()} == direct
    for limit in (50_000, 0):
        out = rc.match_split_pairs(d, p, local_rows=limit)
        assert out.count() == len(ws)
        assert {(r.company_id, r.row_no) for r in out.filter("split").collect()} == split


def test_multiset_diff_is_symmetric(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(1,), (3,)], "v int")
    n = {r.v: (r.missing, r.extra) for r in rc.multiset_counts(a, b, ["v"]).collect()}
    assert n == {1: (1, 0), 2: (1, 0), 3: (0, 1)}
    m = {r.v: (r.extra, r.missing) for r in rc.multiset_counts(b, a, ["v"]).collect()}
    assert m == n
    assert sorted(r.v for r in rc.multiset_except(a, b, ["v"]).collect()) == [1, 2]


def test_summary_words(spark):
    flags = spark.createDataFrame([(1, "p", "federal", 0), (1, "p", "state", 0), (2, "p", "state", 3)], "company_id int, period string, side string, n_issues int")
    got = {r.company_id: (r.federal, r.state, r.overall) for r in rc.reconciliation_summary(flags).collect()}
    assert got == {1: ("PASS", "PASS", "PASSED"), 2: ("PASS", "REVIEW", "NEEDS REVIEW")}


def test_lone_dash_is_zero_and_minus_survives(spark):
    from ledgerloom.functions.money import worksheet_money

    r = spark.createDataFrame([("-", "-5.00", "1,234.5", "x")], "a string, b string, c string, d string").select(*[worksheet_money(c).alias(c) for c in "abcd"]).first()
    assert (r.a, r.b, r.c, r.d) == (Decimal("0.00"), Decimal("-5.00"), Decimal("1234.50"), None)
    assert F.col("a") is not None
