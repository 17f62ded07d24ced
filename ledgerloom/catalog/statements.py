"""Round trips: print orders as statement lines in each layout, parse them back, compare with orders.

A document is one customer and one July-to-June year, so every layout crosses a year end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import cents, cents_sql, orders, query, table
from ledgerloom.operators import reconcile as rc
from ledgerloom.operators import statements as st
from ledgerloom.operators.vendors import compare_company_names, payer_names
from ledgerloom.plans.ordered import block_of, fits, number_rows, spread_of
from ledgerloom.plans.session import cut_lineage
from ledgerloom.sources.readers import read_pasted_worksheet

DOC_SQL = "CAST(o_custkey AS VARCHAR) || '-' || CAST(year(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH) AS VARCHAR)"
BASE_SQL = f"SELECT {DOC_SQL} AS doc_id, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS tx_date, {cents_sql('o_totalprice')} AS c FROM orders"


def _base(spark, d) -> DataFrame:
    o = orders(spark, d)
    fy = F.year(F.add_months("day", -6))
    doc = F.concat_ws("-", F.col("o_custkey").cast("string"), fy.cast("string"))
    o = o.withColumn("fy", fy).withColumn("doc_id", doc).withColumn("shown", F.format_number("price", 2))
    return number_rows(o, ["doc_id"], ["o_orderkey"], [spread_of("o_orderkey")], "rn", near=True)


def _lines(base: DataFrame, head: Sequence[Column], body: Sequence[Column], profile: str) -> DataFrame:
    """Line table: the head once per document, then the body lines of each order. Null lines vanish."""
    n, m = len(head), len(body)
    top = base.select("doc_id", "fy").distinct().select("doc_id", F.posexplode(F.array(*head)).alias("pos", "text"))
    rows = base.select("doc_id", "rn", F.posexplode(F.array(*body)).alias("i", "text"))
    rows = rows.select("doc_id", (F.lit(n) + (F.col("rn") - 1) * m + F.col("i")).alias("pos"), "text")
    out = top.withColumn("pos", F.col("pos").cast("bigint")).unionByName(rows).filter(F.col("text").isNotNull())
    # Positions are dense per document, as a text file's non-blank lines are.
    return out.select("doc_id", F.lit(profile).alias("profile"), F.col("pos").alias("line_no"), "pos", "text")


def _range_head() -> Column:
    return F.format_string("Statement 07/01/%d - 06/30/%d", F.col("fy"), F.col("fy") + 1)


def _parsed(lines: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    tx = st.parse_lines(lines)
    return tx.select("doc_id", "tx_date", "description", cents("amount").alias("cents"), *extra)


def _key() -> Column:
    return F.col("o_orderkey").cast("string")


@query(
    "parse_bank_sectioned",
    f"""SELECT doc_id, tx_date, CASE o_orderstatus WHEN 'P' THEN 'Check ' || (o_orderkey + 1000) ELSE 'ORDER ' || o_orderkey || ' LINE TWO' END AS description,
      CASE o_orderstatus WHEN 'O' THEN c ELSE -c END AS cents, CASE o_orderstatus WHEN 'P' THEN CAST(o_orderkey + 1000 AS VARCHAR) ELSE '' END AS check_number FROM ({BASE_SQL})""",
)
def parse_bank_sectioned(spark, d):
    b = _base(spark, d)
    s = F.col("o_orderstatus")
    check = s == "P"
    title = F.when(s == "O", "Deposits and other credits").when(check, "Checks - continued").otherwise("Withdrawals and other debits")
    body = [
        title, F.lit("Date"), F.when(check, "Check #").otherwise("Description"), F.lit("Amount"), F.date_format("day", "MM/dd/yy"),
        F.when(check, (F.col("o_orderkey") + 1000).cast("string")).otherwise(F.concat(F.lit("ORDER "), _key())),
        F.when(check, F.lit("Date")).otherwise("LINE TWO"), F.concat(F.when(s == "O", "").otherwise("-"), F.col("shown")),
        F.lit("continued on the next page"), F.lit("Page furniture 12"),
    ]
    return _parsed(_lines(b, [_range_head()], body, "bank_sectioned"), ["check_number"])


@query(
    "parse_card_fixed",
    f"SELECT doc_id, tx_date, 'SHOP ' || o_orderkey AS description, CASE o_orderstatus WHEN 'O' THEN c ELSE -c END AS cents, lpad(CAST(o_orderkey AS VARCHAR), 17, '7') AS reference FROM ({BASE_SQL})",
)
def parse_card_fixed(spark, d):
    b = _base(spark, d)
    credit = F.col("o_orderstatus") == "O"
    body = [
        F.when(credit, "Payments and Other Credits").otherwise("Purchases and Other Charges"), F.date_format("day", "MM/dd"), F.date_format("day", "MM/dd"),
        F.concat(F.lit("SHOP "), _key()), F.lpad(_key(), 17, "7"), F.concat(F.when(credit, "- ").otherwise(""), F.col("shown")), F.lit("stray line"),
    ]
    return _parsed(_lines(b, [_range_head()], body, "card_fixed"), ["reference"])


@query(
    "parse_single_line",
    f"SELECT doc_id, tx_date, 'SHOP ' || o_orderkey AS description, -c AS cents, lpad(CAST(o_orderkey AS VARCHAR), 17, '7') AS reference FROM ({BASE_SQL})",
)
def parse_single_line(spark, d):
    b = _base(spark, d)
    line = F.concat_ws(" ", F.date_format("day", "MM/dd"), F.date_format("day", "MM/dd"), F.lit("SHOP"), _key(), F.lpad(_key(), 17, "7"), "shown")
    return _parsed(_lines(b, [_range_head(), F.lit("Purchases and Other Charges")], [line, F.lit("noise")], "card_fixed"), ["reference"])


@query(
    "parse_running_balance",
    f"SELECT doc_id, tx_date, 'ITEM ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' CHECK NO: ' || o_orderkey ELSE ' more' END AS description, CASE o_orderstatus WHEN 'O' THEN c ELSE -c END AS cents, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS check_number FROM ({BASE_SQL})",
)
def parse_running_balance(spark, d):
    from ledgerloom.plans.ordered import Scan, scan

    b = _base(spark, d)
    signed = F.when(F.col("o_orderstatus") == "O", F.col("price")).otherwise(-F.col("price"))
    b = scan(b, ["doc_id"], ["o_orderkey"], [spread_of("o_orderkey")], {"bal": Scan("sum", signed)}, near=True)
    bal = F.col("bal") + F.lit("99999999.00").cast("decimal(18,2)")
    body = [
        F.date_format("day", "MM/dd"), F.concat(F.lit("ITEM "), _key()), F.col("shown"), F.format_number(bal, 2),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("CHECK NO: "), _key())).otherwise("more"),
    ]
    head = [_range_head(), F.lit("Beginning Balance: $99,999,999.00"), F.lit("CHECKING ACTIVITY"), F.lit("Date Description Debits")]
    return _parsed(_lines(b, head, body, "running_balance"), ["check_number"])


@query(
    "parse_amount_date",
    f"SELECT doc_id, tx_date, 'ACME ' || o_orderkey || ' CHK ' || (o_orderkey + 5) AS description, CASE o_orderstatus WHEN 'O' THEN c ELSE -c END AS cents, CAST(o_orderkey + 5 AS VARCHAR) AS check_number FROM ({BASE_SQL})",
)
def parse_amount_date(spark, d):
    b = _base(spark, d)
    body = [
        F.concat(F.lit("ACME "), _key()), F.concat(F.lit("CHK "), (F.col("o_orderkey") + 5).cast("string")),
        F.concat(F.when(F.col("o_orderstatus") == "O", "").otherwise("-"), F.col("shown"), F.lit(" "), F.date_format("day", "MM/dd")),
        F.lit("12,345.67"), F.lit("Page: 3 of 9"),
    ]
    return _parsed(_lines(b, [_range_head(), F.lit("Description Transaction Amount Date")], body, "amount_date"), ["check_number"])


@query(
    "parse_month_day",
    f"SELECT doc_id, tx_date, CASE WHEN o_orderstatus = 'P' THEN 'Check ' || (o_orderkey + 1000) ELSE 'DEPOSIT ' || o_orderkey END AS description, CASE WHEN o_orderstatus = 'O' THEN c ELSE -c END AS cents FROM ({BASE_SQL})",
)
def parse_month_day(spark, d):
    b = _base(spark, d)
    check = F.col("o_orderstatus") == "P"
    amount = F.concat(F.when(F.col("o_orderstatus") == "O", "").otherwise("-"), F.col("shown"))
    day = F.date_format("day", "MMM dd")
    body = [
        F.when(check, "Checks paid this statement period").otherwise("Date Amount Activity"),
        F.when(check, F.concat(F.lit("#"), (F.col("o_orderkey") + 1000).cast("string"))).otherwise(day), amount,
        F.when(check, day).otherwise(F.concat(F.lit("DEPOSIT "), _key())), F.lit("9876543210"), F.when(check, "Total checks paid").otherwise("Account summary"),
    ]
    head = [F.format_string("July 1, %d to June 30, %d", F.col("fy"), F.col("fy") + 1)]
    return _parsed(_lines(b, head, body, "month_day"))


@query(
    "parse_sectioned_checking",
    f"SELECT doc_id, tx_date, CASE WHEN o_orderstatus = 'P' THEN 'Check ' || (o_orderkey + 1000) ELSE 'Transfer REF=AB' || o_orderkey END AS description, CASE WHEN o_orderstatus = 'O' THEN c ELSE -c END AS cents, CASE WHEN o_orderstatus = 'P' THEN '7' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') ELSE 'AB' || o_orderkey END AS reference FROM ({BASE_SQL})",
)
def parse_sectioned_checking(spark, d):
    b = _base(spark, d)
    s = F.col("o_orderstatus")
    check = s == "P"
    day = F.date_format("day", "MMM dd")
    body = [
        F.when(check, "Checks Presented Conventionally").when(s == "O", "Other Deposits").otherwise("Other Withdrawals"),
        F.when(check, (F.col("o_orderkey") + 1000).cast("string")).otherwise(F.concat(day, F.lit(" Transfer"))),
        F.when(check, day).otherwise(F.concat(F.lit("REF=AB"), _key())),
        F.when(check, F.concat(F.lit("7"), F.lpad(_key(), 9, "0"))).otherwise(F.lit("$")),
        F.concat(F.col("shown"), F.when(s == "F", "-").otherwise("")), F.lit("Balance Summary"),
    ]
    head = [F.format_string("Statement Period: Jul 1, %d through Jun 30, %d", F.col("fy"), F.col("fy") + 1)]
    return _parsed(_lines(b, head, body, "sectioned_checking"), ["reference"])


@query(
    "parse_card_open_close",
    f"SELECT doc_id, tx_date, CASE WHEN o_orderkey % 3 = 0 THEN 'REFUND ' ELSE 'COFFEE ' END || o_orderkey AS description, CASE WHEN o_orderstatus = 'O' OR o_orderkey % 3 = 0 THEN c ELSE -c END AS cents, CAST(o_orderkey + 10000 AS VARCHAR) AS reference FROM ({BASE_SQL})",
)
def parse_card_open_close(spark, d):
    b = _base(spark, d)
    body = [
        F.when(F.col("o_orderstatus") == "O", "Payments and Other Credits").otherwise("Purchases and Other Debits"),
        F.date_format(F.date_sub("day", 1), "MM/dd"), F.date_format("day", "MM/dd"), (F.col("o_orderkey") + 10000).cast("string"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, "REFUND ").otherwise("COFFEE "), _key()), F.concat(F.lit("$"), F.col("shown")),
    ]
    head = [F.format_string("Open Date: 07/01/%d Closing Date: 06/30/%d", F.col("fy"), F.col("fy") + 1)]
    return _parsed(_lines(b, head, body, "card_open_close"), ["reference"])


@query(
    "parse_card_billing",
    f"""WITH b AS ({BASE_SQL})
    SELECT doc_id, tx_date, 'FUEL ' || o_orderkey AS description, CASE WHEN o_orderstatus = 'O' THEN c ELSE -c END AS cents FROM b
    UNION ALL SELECT DISTINCT doc_id, make_date(CAST(split_part(doc_id, '-', 2) AS INT) + 1, 6, 30), 'Interest Charge on Purchases', -1234 FROM b""",
)
def parse_card_billing(spark, d):
    b = _base(spark, d)
    credit = F.col("o_orderstatus") == "O"
    day = F.date_format("day", "MMM d")
    body = [
        F.when(credit, "JO #1234: Payments, Credits and Adjustments").otherwise("JO #1234: Transactions"), day, day,
        F.concat(F.lit("FUEL "), _key()), F.lit("TK#: 99"), F.concat(F.when(credit, "- ").otherwise(""), F.lit("$"), F.col("shown")), F.lit("Trans Date"),
    ]
    head = [
        F.format_string("Jul 1, %d - Jun 30, %d | 365 days in Billing Cycle", F.col("fy"), F.col("fy") + 1), F.lit("Interest Charged"),
        F.lit("Interest Charge on Purchases"), F.lit("$12.34"), F.lit("Total Interest for This Period"),
    ]
    return _parsed(_lines(b, head, body, "card_billing"))


@query(
    "split_by_counts",
    f"""WITH r AS (SELECT doc_id, o_orderkey, c, row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) AS rn FROM ({BASE_SQL}))
    SELECT doc_id, 'ITEM ' || o_orderkey AS description, CASE WHEN rn <= 1 THEN 'customer_deposit' WHEN rn <= 3 THEN 'other_deposit' WHEN rn <= 4 THEN 'withdrawal' ELSE 'check' END AS section,
      CASE WHEN rn <= 3 THEN c ELSE -c END AS cents FROM r WHERE rn <= 7""",
)
def split_by_counts(spark, d):
    b = _base(spark, d)
    head = [
        F.format_string("Statement Period: Jul 1, %d through Jun 30, %d", F.col("fy"), F.col("fy") + 1), F.lit("Beginning Balance on Jul 1"),
        F.lit("Customer Deposits 1 10.00"), F.lit("Other Deposits"), F.lit("2"), F.lit("Other Withdrawals 1"), F.lit("Checks Paid"), F.lit("3"), F.lit("Other Deposits (continued) 2"),
    ]
    body = [F.date_format("day", "MMM dd"), F.concat(F.lit("ITEM "), _key()), F.col("shown")]
    # Marked lines feed two scans, so they are written once; a look at the positions tells both how long documents are.
    marked = cut_lineage(st.mark_lines(_lines(b, head, body, "sectioned_checking")))
    short = fits(marked, ["doc_id"], [block_of("pos")])
    records = st.assemble_blocks(marked, short=short)
    out, _ = st.split_by_summary_counts(records, st.summary_counts(marked, short), short)
    return out.select("doc_id", "description", "section", cents("amount").alias("cents"))


@query(
    "section_tag",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), chr(10))) AS t,
        generate_subscripts(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), chr(10)), 1) - 1 AS line_no FROM documents),
    k AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, trim(t) AS t FROM l WHERE trim(t) <> ''),
    s AS (SELECT *, CASE WHEN regexp_matches(t, '^[A-F]') THEN 'a-f' WHEN regexp_matches(t, '^[G-M]') THEN '' WHEN regexp_matches(t, '^[N-Z]') THEN 'n-z' END AS mk FROM k),
    c AS (SELECT doc_id, line_no, t, mk, last_value(mk IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM s)
    SELECT doc_id, coalesce(section, '') AS section, count(*) AS n_lines, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM c WHERE mk IS NULL GROUP BY ALL""",
)
def section_tag(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    t = F.col("text")
    mk = F.when(t.rlike("^[A-F]"), "a-f").when(t.rlike("^[G-M]"), "").when(t.rlike("^[N-Z]"), "n-z")
    marked = st.text_to_lines(docs).withColumn("mk_section", mk).withColumn("is_noise", F.lit(False))
    kept = st.drop_noise_lines(st.tag_sections(marked))
    return kept.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(
    "classify_statements",
    """WITH p AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'Fremont Bank ' WHEN doc_id % 7 = 1 THEN 'Comerica ' WHEN doc_id % 7 = 2 THEN 'US Bank cardmember ' WHEN doc_id % 7 = 3 THEN 'U.S. Bank checking ' WHEN doc_id % 7 = 4 THEN 'Capital One Spark Cash ' WHEN doc_id % 7 = 5 THEN 'Bank of America credit card ' ELSE '' END || text AS full_text FROM documents),
    l AS (SELECT doc_id, lower(full_text) AS t FROM p)
    SELECT doc_id, CASE WHEN contains(t, 'fremont') THEN 'amount_date' WHEN contains(t, 'comerica') THEN 'month_day' WHEN contains(t, 'citibank') OR contains(t, ' citi ') THEN 'running_balance'
      WHEN contains(t, 'bank of america') OR contains(t, 'bofa') THEN CASE WHEN contains(t, 'withdrawals and other debits') THEN 'bank_sectioned' WHEN contains(t, 'credit card') THEN 'card_fixed' ELSE 'bank_sectioned' END
      WHEN contains(t, 'u.s. bank') OR contains(t, 'us bank') OR contains(t, 'usbank') THEN CASE WHEN contains(t, 'credit card') OR contains(t, 'cardmember') THEN 'card_open_close' ELSE 'sectioned_checking' END
      WHEN contains(t, 'capital one') THEN 'card_billing' END AS profile FROM l""",
)
def classify_statements(spark, d):
    k = F.col("doc_id") % 7
    names = ("Fremont Bank ", "Comerica ", "US Bank cardmember ", "U.S. Bank checking ", "Capital One Spark Cash ", "Bank of America credit card ")
    lead = F.lit("")
    for i, name in enumerate(names):
        lead = F.when(k == i, name).otherwise(lead)
    docs = table(spark, d, "documents").select("doc_id", F.concat(lead, F.col("text")).alias("text"))
    return st.classify_document(docs).select("doc_id", "profile")


@query(
    "canonical_rows",
    f"""SELECT doc_id, strftime(tx_date, '%m/%d/%Y') AS "Date", 'ORDER ' || o_orderkey || ' OAKLAND CA' AS "Description", 'ORDER ' || o_orderkey || ' OAKLAND' AS "Merchant",
      'CA' AS "State", '' AS "Payee", CASE WHEN o_orderstatus = 'O' THEN c ELSE -c END AS cents FROM ({BASE_SQL}) WHERE o_orderstatus <> 'O'""",
)
def canonical_rows(spark, d):
    b = _base(spark, d)
    tx = b.select("doc_id", F.col("o_orderkey").alias("line_no"), F.col("day").alias("tx_date"), F.concat(F.lit("ORDER "), _key(), F.lit(" OAKLAND CA")).alias("description"),
                  F.when(F.col("o_orderstatus") == "O", F.col("price")).otherwise(-F.col("price")).alias("amount"), F.lit("").alias("reference"))
    twice = st.union_transactions(tx, tx.withColumn("line_no", F.col("line_no") + 1000000))
    unique = st.filter_direction(st.dedupe_transactions(twice), "debits")
    out = st.canonical_transactions(st.split_merchant_location(unique))
    return out.select("doc_id", "Date", "Description", "Merchant", "State", "Payee", cents("Amount").alias("cents"))


@query(
    "federal_payment_lines",
    f"SELECT doc_id, tx_date AS settlement_date, CAST(tx_date - INTERVAL 1 DAY AS DATE) AS initiation_date, c AS cents, CASE o_orderstatus WHEN 'O' THEN 'Settled' WHEN 'F' THEN 'Returned' ELSE 'Scheduled' END AS status FROM ({BASE_SQL}) WHERE year(tx_date) = 1997 AND quarter(tx_date) = 2",
)
def federal_payment_lines(spark, d):
    b = _base(spark, d)
    s = F.col("o_orderstatus")
    body = [
        F.date_format("day", "yyyy-MM-dd"), F.date_format(F.date_sub("day", 1), "yyyy-MM-dd"), F.lit("941"), F.concat_ws("/Q", F.year("day").cast("string"), F.quarter("day").cast("string")),
        F.col("shown"), F.when(s == "O", "Settled").when(s == "F", "Return").otherwise("Scheduled"), F.lit("Confirmation"),
    ]
    parsed = rc.parse_federal_payments(_lines(b, [F.lit("TAXPAYER NAME:")], body, "none"))
    return rc.filter_payment_period(parsed, "1997/Q2").select("doc_id", "settlement_date", "initiation_date", cents("amount").alias("cents"), "status")


@query(
    "state_payment_rows",
    f"SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS pay_date, CASE WHEN o_orderkey % 2 = 0 THEN {cents_sql('o_totalprice')} ELSE 1250 END AS cents FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-04-01' AND DATE '1997-06-30'",
)
def state_payment_rows(spark, d):
    o = orders(spark, d)
    day, shown = F.date_format("day", "dd-MMM-yyyy"), F.concat(F.lit("$"), F.format_number("price", 2))
    even = F.col("o_orderkey") % 2 == 0
    row = F.concat_ws(" ", F.lit("junk"), day, F.lit("DE88 Payment\n"), day, F.when(even, "$1.00").otherwise("$12.50"), F.when(even, shown), F.lit("tail"))
    pays = rc.parse_state_payments(o.select(F.col("o_orderkey").alias("doc_id"), row.alias("text")))
    kept = rc.filter_payment_period(pays, start=F.lit("1997-04-01").cast("date"), end=F.lit("1997-06-30").cast("date"))
    return kept.select("doc_id", "pay_date", cents("amount").alias("cents"))


@query(
    "pasted_worksheet",
    f"""SELECT doc_id, o_orderkey AS row_no, tx_date AS date, c AS total, CAST(0 AS BIGINT) AS ui, -c AS ett, CASE WHEN cust % 4 = 0 THEN NULL ELSE CAST(100 AS BIGINT) END AS ui_ett, c AS edd_total
    FROM (SELECT *, CAST(split_part(doc_id, '-', 1) AS BIGINT) AS cust FROM ({BASE_SQL}))""",
)
def pasted_worksheet(spark, d):
    b = _base(spark, d)
    k = F.col("o_custkey") % 4
    one, two = F.date_format("day", "MM/dd/yyyy"), F.concat_ws(" ", F.date_format(F.date_sub("day", 3), "yyyy-MM-dd"), F.date_format("day", "M/d/yy"))
    s = F.col("shown")
    neg = F.concat(F.lit("-"), s)
    line = (
        F.when(k == 0, F.concat_ws(" ", one, s, F.lit("-"), neg, F.lit("2.00 3.00"), s))
        .when(k == 1, F.concat_ws(" ", one, s, F.lit("-"), neg, F.lit("1.00 2.00 3.00"), s))
        .when(k == 2, F.concat_ws("  ", one, s, F.lit("-"), neg, F.lit("1.00 2.00 3.00 5.00"), s))
        .otherwise(F.concat_ws(" ", two, s, F.lit("-"), neg, F.lit("1.00 2.00 3.00 5.00"), s))
    )
    ws = read_pasted_worksheet(b.select("doc_id", F.col("o_orderkey").alias("pos"), line.alias("text")))
    return ws.select("doc_id", "row_no", "date", *[cents(c).alias(c) for c in ("total", "ui", "ett", "ui_ett", "edd_total")])


@query(
    "company_name_check",
    """SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'dba' WHEN 2 THEN 'none' ELSE 'left_only' END AS result FROM customer""",
)
def company_name_check(spark, d):
    c = table(spark, d, "customer").withColumn("doc_id", F.col("c_custkey").cast("string"))
    k = F.col("c_custkey") % 4
    # The paycheck side is printed as lines and read back; the payroll side spells suffixes out.
    body = F.array(F.lit("MEMO: Pay Period"), F.lit("01/01"), F.concat("c_name", F.lit(", Inc.")), F.lit("Street"), F.concat(F.lit("DBA "), F.col("c_name"), F.lit(" Co")))
    lines = c.select("doc_id", F.posexplode(body).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))
    left = payer_names(lines, "paycheck")
    other = F.when(k == 0, F.concat("c_name", F.lit(" INCORPORATED"))).when(k == 1, F.concat(F.lit("Dba "), F.col("c_name"), F.lit(" Company"))).otherwise("Another Ltd")
    right = c.filter(k != 3).select("doc_id", other.alias("name"))
    return compare_company_names(left, right).select("doc_id", "result")
