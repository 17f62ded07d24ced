"""Steps that must not be paid for twice: plans of the shared parse step, worksheets, owners, returns and contained terms."""

import datetime as dt
import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import entities as en
from ledgerloom.operators import reconcile as rc
from ledgerloom.operators import statements as st
from ledgerloom.operators import vendors as vd
from ledgerloom.plans import ordered

LINES = "doc_id string, profile string, line_no bigint, pos bigint, text string"


def _lines(spark, profile, docs):
    return spark.createDataFrame([(d, profile, i, i, t) for d, texts in docs.items() for i, t in enumerate(texts)], LINES)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_assembled_rows_stay_dealt_out_by_document(spark):
    head = "July 1, 2020 to June 30, 2021"
    docs = {
        "a": [head, "Jul 04", "1,000.00", "DEPOSIT ONE", "Jul 05", "never paid", "Checks paid this statement period", "#1234", "-5.00", "Aug 09", "Total checks paid"],
        "b": [head, "Jan 02", "7.50", "DEPOSIT TWO", "Jan 02", "7.50", "DEPOSIT TWO"],
    }
    out = st.parse_lines(_lines(spark, "month_day", docs))
    got = {(r.doc_id, r.tx_date, r.description, r.amount) for r in out.collect()}
    assert got == {
        ("a", dt.date(2020, 7, 4), "DEPOSIT ONE", Decimal("1000.00")), ("a", dt.date(2020, 8, 9), "Check 1234", Decimal("-5.00")),
        ("b", dt.date(2021, 1, 2), "DEPOSIT TWO", Decimal("7.50")),
    }
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)", out._jdf.queryExecution().executedPlan().toString())
    assert shuffles and all("description" not in s for s in shuffles)


def test_long_documents_are_parsed_like_short_ones(spark, monkeypatch):
    docs = {
        "a": ["Statement Period: Jul 1, 2020 through Jun 30, 2021", *[t for n in range(9) for t in ("Other Deposits", f"Jul {n + 10} IN", f"{n + 1}.00", "Checks Paid", str(2000 + n), "Aug 01", f"{n + 1}.50")]],
        "b": ["Statement Period: Jul 1, 2020 through Jun 30, 2021", "Other Withdrawals", "Jul 03 OUT", "4.00-"],
    }
    parse = lambda: sorted((r.doc_id, str(r.tx_date), r.description, r.amount) for r in st.parse_lines(_lines(spark, "sectioned_checking", docs)).collect())
    short = parse()
    assert len(short) == 19
    monkeypatch.setattr(st, "block_of", lambda c: ordered.block_of(c, 7))
    assert parse() == short


def test_checks_and_dates_are_assembled_in_one_pass_dealt_by_lines(spark, monkeypatch):
    month = [
        "July 1, 2020 to June 30, 2021", "Jul 04", "Account summary", "1,000.00", "DEPOSIT", "Page 2", "ONE", "Jul 05", "1234567", "lost", "8.00", "Checks paid this statement period",
        "#1234", "Aug 09", "Page 3", "-5.00", "ACME", "9876543", "#1235", "6.00", "Total checks paid", "Jul 06", "5.00", "LATE",
    ]
    plain = ["Statement Period: Jul 1, 2020 through Jun 30, 2021", "Checks Paid", "2001", "$", "2002", "Aug 01", "7001234567", "3.50", "Balance Summary", "Other Deposits", "Jul 10 IN", "$", "2.00"]
    lines = _lines(spark, "month_day", {"m": month}).unionByName(_lines(spark, "sectioned_checking", {"s": plain, "t": ["Jul 1, 2020"]}))
    want = {
        ("m", "2020-07-04", "DEPOSIT ONE", "1000.00", "", ""), ("m", "2020-08-09", "Check 1234", "-5.00", "1234", ""), ("m", "2020-07-06", "LATE", "5.00", "", ""),
        ("s", "2020-08-01", "Check 2002", "-3.50", "2002", "7001234567"), ("s", "2020-07-10", "IN", "2.00", "", ""),
    }
    read = lambda out: {(r.doc_id, str(r.tx_date), r.description, str(r.amount), r.check_number, r.reference) for r in out.collect()}
    assert read(st.parse_lines(lines)) == want
    monkeypatch.setattr(st, "TASK_LINES", 4)
    assert read(st.parse_lines(lines)) == want
    dealt = re.findall(r"RepartitionByExpression \[doc_id#\d+\], (\d+)", _optimized(st.parse_lines(lines.filter("doc_id = 'm'"))))
    assert dealt == ["6", "6"]  # the records and the period
    monkeypatch.setattr(st, "block_of", lambda c: ordered.block_of(c, 5))
    assert read(st.parse_lines(lines)) == want


def test_single_lines_are_matched_once(spark):
    docs = {"a": ["Purchases and Other Charges", "07/01 07/02 SHOP 5 777777777777777 1,234.50", "07/01 07/02 SHOP 6 777777777777777 ,", "noise"]}
    rows = st.parse_single_line(st.mark_lines(_lines(spark, "card_fixed", docs)))
    assert [(r.description, r.amount, r.reference) for r in rows.collect()] == [("SHOP 5", Decimal("1234.50"), "7" * 15)]
    assert "Generate inline" in _optimized(rows)


def test_documents_of_single_lines_alone_are_not_assembled(spark):
    one = ["Statement 07/01/2020 - 06/30/2021", "Purchases and Other Charges", "08/01 08/02 SHOP 5 777777777777777 1,234.50", "noise"]
    five = ["Statement 07/01/2020 - 06/30/2021", "Purchases and Other Charges", "09/01", "09/02", "SHOP 6", "8" * 17, "7.00"]
    read = lambda out: {(r.doc_id, str(r.tx_date), r.description, r.reference) for r in out.collect()}
    alone = st.parse_lines(_lines(spark, "card_fixed", {"a": one, "b": one}))
    assert read(alone) == {(d, "2020-08-01", "SHOP 5", "7" * 15) for d in "ab"}
    assert "LeftAnti" not in _optimized(alone)
    both = st.parse_lines(_lines(spark, "card_fixed", {"a": one, "b": five, "c": one + five}))
    assert read(both) == {("a", "2020-08-01", "SHOP 5", "7" * 15), ("b", "2020-09-01", "SHOP 6", "8" * 17), ("c", "2020-08-01", "SHOP 5", "7" * 15)}


def test_counted_statements_are_printed_once(spark, tmp_path):
    from ledgerloom.catalog.statements import split_by_counts

    day = dt.datetime(2020, 8, 1)
    spark.createDataFrame([(n, 1, "O", 10.0 + n, day) for n in range(9)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    out = split_by_counts(spark, str(tmp_path))
    want = ["customer_deposit", "other_deposit", "other_deposit", "withdrawal", "check", "check", "check"]
    assert [r.section for r in out.orderBy("description").collect()] == want
    assert "o_orderkey" not in _optimized(out)


def test_dates_and_cells_of_a_worksheet_are_read_once(spark):
    from ledgerloom.functions.dates import date_parse
    from ledgerloom.functions.money import money_parse

    texts = ["2020-01-02x", "20200102", "1/2/20", "01-02-1970", "3.4.99", "5-Mar-68", "13/1/20", "1/2/202", "2-Foo-20", " 1/2/2020 ", "", None]
    days = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(date_parse("t")).collect()]
    d = dt.date
    assert days == [d(2020, 1, 2), d(2020, 1, 2), d(2020, 1, 2), d(1970, 1, 2), d(1999, 3, 4), d(2068, 3, 5), None, None, None, d(2020, 1, 2), None, None]
    texts = ["$1,234.5", "-5", "5.00-", "+.5", "1.", "--5", "5-5", "1.005", "-1.005", "x", "", None, "9" * 17]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["1234.50", "-5.00", "-5.00", "0.50", "1.00", None, None, "1.01", "-1.01", None, None, None, None]
    assert [r[0] and str(r[0]) for r in df.select(money_parse("t")).collect()] == want
    read = _optimized(df.select(money_parse("t").alias("m"), date_parse("t").alias("d")))
    assert read.count("regexp_replace") == 1 and read.count("RLIKE") <= 5 and "regexp_extract" not in read


def test_returns_of_short_groups_are_written_once(spark, monkeypatch):
    rng = random.Random(2)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 9))
    rows = [(rng.choice([1, 2, None]), "p", n, day(), None, Decimal(rng.randint(1, 2)), rng.choice(["Settled", "Returned"])) for n in range(120)]
    df = spark.createDataFrame(rows, "company_id int, period string, row_no int, settlement_date date, initiation_date date, amount decimal(18,2), status string")
    written = []
    keep = lambda frame: written.append(1) or frame
    with monkeypatch.context() as m:
        m.setattr(rc, "cut_lineage", keep)
        m.setattr(ordered, "cut_lineage", keep)
        short = [sorted(map(str, part.collect())) for part in rc.cancel_returned_payments(df)]
    assert len(written) == 1
    monkeypatch.setattr(rc, "CHUNK_ROWS", 5)
    assert [sorted(map(str, part.collect())) for part in rc.cancel_returned_payments(df)] == short


def test_runs_of_no_term_never_become_rows(spark, monkeypatch):
    left = spark.createDataFrame([("BLUE RING BRAND#7 #10012345",), ("HOT BOLT",), ("xyz",)], "x string")
    right = spark.createDataFrame([("BLUE RING",), ("BOLT",), ("HO",)], "y string")
    pairs = lambda: {(r.x, r.y) for r in vd.contained_pairs(left, "x", right, "y").collect()}
    few = pairs()
    assert few == {("BLUE RING BRAND#7 #10012345", "BLUE RING"), ("HOT BOLT", "BOLT"), ("HOT BOLT", "HO")}
    assert re.search(r" IN \(", _optimized(vd.contained_pairs(left, "x", right, "y")))
    monkeypatch.setattr(vd, "LISTED_RUNS", 1)
    assert pairs() == few
def test_tasks_without_an_owner_do_not_meet_in_one_task(spark, monkeypatch):
    clients = spark.createDataFrame([(1, "Ann", "", "12-3456789", ""), (2, "Bob", "", "", "")], "client_idx int, name string, id string, ein string, ssn string")
    rows = [(n, None, "", "nobody") for n in range(400)] + [(1000, 1, "", ""), (1001, None, " ANN ", ""), (1002, None, "bob", "x"), (1003, None, None, "123456789"), (1004, 9, "", "")]
    tasks = spark.createDataFrame(rows, "n int, client_idx int, client_name string, client_id string")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = en.resolve_task_owner(tasks, clients).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {r.n: (r.client_id, r.outcome) for r in found}
    number = "123456789"
    assert {n: got[n] for n in range(1000, 1005)} == {1000: (number, "updated"), 1001: (number, "updated"), 1002: ("x", "no_number"), 1003: (number, "unchanged"), 1004: ("", "not_found")}
    assert all(got[n] == ("nobody", "not_found") for n in range(400))
    parts = [r.at for r in found if r.n < 400]
    assert max(parts.count(p) for p in set(parts)) < 200


