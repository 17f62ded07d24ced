"""Chunked scans against plain loops."""

import random
import re

from pyspark.sql import functions as F

from ledgerloom.plans.ordered import Scan, block_of, first_per_key, number_rows, scan


def test_scan_equals_loop_across_chunks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, rng.randint(-5, 5)])) for k in "ab" for i in range(40 if k == "a" else 3)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    specs = {n: Scan(n, F.col("v")) for n in ("sum", "prev_sum", "last", "prev_last", "min", "prev_min")}
    got = {(r.k, r.i): r for r in scan(df, ["k"], ["i"], [block_of("i", 7)], specs).collect()}
    plain = {(r.k, r.i): r for r in scan(df, ["k"], ["i"], None, specs).collect()}
    state = {}
    for k, i, v in rows:
        s = state.setdefault(k, {"sum": 0, "last": None, "min": None})
        before = dict(s)
        if v is not None:
            s["sum"] += v
            s["last"] = v
            s["min"] = v if s["min"] is None else min(s["min"], v)
        for r in (got[k, i], plain[k, i]):
            assert (r["sum"], r["last"], r["min"]) == (s["sum"], s["last"], s["min"])
            assert (r["prev_sum"], r["prev_last"], r["prev_min"]) == (before["sum"], before["last"], before["min"])


def test_number_rows_and_first_per_key(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))
    ranks = number_rows(df, ["k"], ["i"], [block_of("i", 10)], "n").collect()
    assert all(r.n == r.i // 3 + 1 for r in ranks)
    assert {(r.k, r.i) for r in first_per_key(df, ["k"], ["i"]).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {(r.k, r.i) for r in first_per_key(df, ["k"], ["i"], last=True).collect()} == {(0, 99), (1, 97), (2, 98)}


def test_gaps_and_one_large_key_still_make_bounded_chunks(spark):
    from ledgerloom.plans.ordered import _spread, spread_of

    rows = [(0, i * 1000) for i in range(900)] + [(k, k * 7) for k in range(1, 101)]
    df = spark.createDataFrame(rows, "k int, i bigint")
    sizes = _spread(df, ["k"], spread_of("i", 50), "c").groupBy("k", "c").count().collect()
    assert max(r["count"] for r in sizes) <= 50 and sum(r.k == 0 for r in sizes) == 18
    ranks = {(r.k, r.i): r.n for r in number_rows(df, ["k"], ["i"], [spread_of("i", 50)], "n").collect()}
    assert all(n == (i // 1000 + 1 if k == 0 else 1) for (k, i), n in ranks.items())


def test_chained_scans_read_their_input_once(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))
    run = scan(df, ["k"], ["i"], [block_of("i", 10)], {"a": Scan("sum", F.col("i"))})
    run = scan(run, ["k"], ["i"], [block_of("i", 10)], {"b": Scan("sum", F.col("a"))})
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "Range" not in plan


def test_short_groups_are_scanned_in_one_shuffle(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))
    run = scan(df, ["k"], ["i"], [block_of("i")], {"a": Scan("sum", F.col("i"))})
    run = scan(run, ["k"], ["i"], None, {"b": Scan("sum", F.col("a"))})
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    again = scan(df, ["k"], ["i"], [block_of("i", 10)], {"a": Scan("sum", F.col("i"))})
    assert again.dtypes == scan(df, ["k"], ["i"], [block_of("i")], {"a": Scan("sum", F.col("i"))}).dtypes
    assert again.agg(F.sum("a")).first() == run.agg(F.sum("a")).first()


def test_lines_counted_backward_begin_in_the_first_chunk(spark):
    from ledgerloom.plans.ordered import fits

    df = spark.range(40).select(F.lit(1).alias("k"), (-F.col("id")).alias("back"))
    assert fits(df, ["k"], [block_of("back", 40)]) and not fits(df, ["k"], [block_of("back", 39)])
    got = {r.back: r.n for r in scan(df, ["k"], ["back"], [block_of("back", 7)], {"n": Scan("sum", F.lit(1))}).collect()}
    assert got == {-i: 40 - i for i in range(40)}


def test_date_parts_are_read_once(spark):
    from ledgerloom.functions.dates import month_number, safe_date

    df = spark.createDataFrame([(2024, "February", 29), (2023, "Feb", 29), (2024, "Fe", 1), (None, "Mar", 1), (2024, "ebm", 1)], "y int, m string, d int")
    dated = df.select(safe_date(F.col("y"), month_number("m"), F.col("d")).cast("string").alias("t"))
    assert [r.t for r in dated.collect()] == ["2024-02-29", None, None, None, None]
    logical = dated._jdf.queryExecution().logical().toString()
    assert len(re.findall(r"'[ymd]\b", logical)) == 3


def test_runs_of_numbers_across_slices(spark, monkeypatch):
    from ledgerloom.operators import payroll as pr

    texts = ["[1] Employee A", "IN", "1", "2", "3", "9", "4", "OUT", "5", "5", "5", "5", "OUT", "1", "2", "8"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, pos bigint, text string")
    for size in (1 << 18, 5, 4, 3):
        monkeypatch.setattr(pr, "CHUNK_ROWS", size)
        assert [(r.employee, r.days) for r in pr.threshold_days(lines, 8.0).collect()] == [("Employee A", 1)]
    assert "sequence" not in pr.threshold_days(lines, 8.0)._jdf.queryExecution().logical().toString()


def test_name_parts_are_split_once(spark):
    from ledgerloom.functions.payroll_text import wage_name

    df = spark.createDataFrame([("ANNA Q SMITH-JONES JR",), ("DOE, JANE K",), ("",)], "t string")
    rows = [tuple(r[0]) for r in df.select(wage_name(F.col("t"))).collect()]
    assert rows == [("Anna", "Q", "Smith-Jones JR"), ("Jane", "K", "Doe"), ("", "", "")]
