"""Reconciliation queries: orders as the worksheet, shifted copies and events as payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import cents, orders, query, table
from ledgerloom.operators import reconcile as rc

# Totals are rounded to thousands so equal amounts repeat inside a company.
WS_SQL = """SELECT o_custkey AS company_id, CAST(year(o_orderdate) AS VARCHAR) AS period, o_orderkey AS row_no, CAST(o_orderdate AS DATE) AS date,
  CAST(floor(o_totalprice / 100000) * 1000 AS BIGINT) AS t FROM orders"""
PAY_SQL = f"SELECT company_id, period, row_no, CASE WHEN row_no % 11 = 0 THEN date + 1 ELSE date END AS date, CASE WHEN row_no % 7 = 0 THEN t + 1000 ELSE t END AS t FROM ({WS_SQL}) WHERE row_no % 5 <> 0"
KEY = ["company_id", "period"]


def worksheet(spark, d) -> DataFrame:
    o = orders(spark, d)
    total = (F.floor(F.col("o_totalprice") / 100000) * 1000).cast("decimal(18,2)")
    return o.select(F.col("o_custkey").alias("company_id"), F.year("day").cast("string").alias("period"), F.col("o_orderkey").alias("row_no"), F.col("day").alias("date"), total.alias("total"))


def payments(spark, d) -> DataFrame:
    ws = worksheet(spark, d).filter(F.col("row_no") % 5 != 0)
    day = F.when(F.col("row_no") % 11 == 0, F.date_add("date", 1)).otherwise(F.col("date"))
    amount = F.when(F.col("row_no") % 7 == 0, F.col("total") + 1000).otherwise(F.col("total")).cast("decimal(18,2)")
    return ws.select(*KEY, "row_no", day.alias("settlement_date"), day.alias("pay_date"), amount.alias("amount"))


def whole(c: str):
    return F.col(c).cast("bigint").alias(c)


@query(
    "multiset_diff",
    f"""WITH w AS (SELECT company_id, period, date, t, count(*) AS a FROM ({WS_SQL}) WHERE t <> 0 GROUP BY ALL), p AS (SELECT company_id, period, date, t, count(*) AS b FROM ({PAY_SQL}) GROUP BY ALL),
    c AS (SELECT company_id, period, date, t, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM w FULL OUTER JOIN p USING (company_id, period, date, t))
    SELECT company_id, period, date, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS n_missing, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS n_extra,
      coalesce(string_agg(CASE WHEN a > b THEN t || '.00x' || (a - b) END, ', ' ORDER BY t), '') AS missing, coalesce(string_agg(CASE WHEN b > 0 THEN t || '.00x' || b END, ', ' ORDER BY t), '') AS payments_paid
    FROM c GROUP BY ALL HAVING sum(abs(a - b)) > 0""",
)
def multiset_diff(spark, d):
    ws = worksheet(spark, d).withColumn("is_returned", F.lit(False))
    out = rc.multiset_diff(ws, payments(spark, d), KEY)
    return out.select(*KEY, "date", "n_missing", "n_extra", "missing", "payments_paid")


@query(
    "multiset_except",
    f"SELECT company_id, t AS total FROM ({WS_SQL}) EXCEPT ALL SELECT company_id, t FROM ({PAY_SQL})",
)
def multiset_except(spark, d):
    right = payments(spark, d).withColumnRenamed("amount", "total")
    return rc.multiset_except(worksheet(spark, d), right, ["company_id", "total"]).select("company_id", whole("total"))


@query(
    "direct_match",
    f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY company_id, period, t ORDER BY row_no) AS rn FROM ({WS_SQL})), p AS (SELECT company_id, period, t, count(*) AS n FROM ({PAY_SQL}) GROUP BY ALL)
    SELECT w.company_id, row_no, t AS edd_total, coalesce(rn <= n, FALSE) AS direct FROM w LEFT JOIN p USING (company_id, period, t)""",
)
def direct_match(spark, d):
    ws = worksheet(spark, d).withColumnRenamed("total", "edd_total")
    return rc.match_direct(ws, payments(spark, d), KEY).select("company_id", "row_no", whole("edd_total"), "direct")


@query(
    "sum_check",
    f"""WITH r AS (SELECT * FROM ({PAY_SQL}) WHERE row_no % 13 = 0), w AS (SELECT w.*, r.row_no IS NOT NULL AS ret FROM ({WS_SQL}) w LEFT JOIN (SELECT DISTINCT company_id, period, date, t, 1 AS row_no FROM r) r USING (company_id, period, date, t)),
    a AS (SELECT company_id, period, sum(CASE WHEN NOT ret THEN t END) AS wp, sum(CASE WHEN ret THEN t END) AS wr FROM w GROUP BY ALL), b AS (SELECT company_id, period, sum(t) AS pp FROM ({PAY_SQL}) WHERE row_no % 13 <> 0 GROUP BY ALL), c AS (SELECT company_id, period, sum(t) AS pr FROM r GROUP BY ALL)
    SELECT company_id, period, CAST(coalesce(wp, 0) AS BIGINT) AS ws_paid, CAST(coalesce(pp, 0) AS BIGINT) AS pay_paid, CAST(coalesce(wr, 0) AS BIGINT) AS ws_returned, CAST(coalesce(pr, 0) AS BIGINT) AS pay_returned,
      coalesce(wp, 0) = coalesce(pp, 0) AS paid_ok, coalesce(wr, 0) = coalesce(pr, 0) AS returned_ok FROM a FULL OUTER JOIN b USING (company_id, period) FULL OUTER JOIN c USING (company_id, period)""",
)
def sum_check(spark, d):
    pay = payments(spark, d)
    gone = pay.filter(F.col("row_no") % 13 == 0).withColumn("cancelled_date", F.col("settlement_date"))
    ws = rc.flag_returned_worksheet_rows(worksheet(spark, d), gone, KEY)
    out = rc.sum_checks(ws, pay.filter(F.col("row_no") % 13 != 0), gone, KEY)
    return out.select(*KEY, *[whole(c) for c in ("ws_paid", "pay_paid", "ws_returned", "pay_returned")], "paid_ok", "returned_ok")


# Purchases are payments and errors are returns; value steps give equal amounts per user.
EV_SQL = """SELECT event_id AS row_no, user_id AS company_id, 'all' AS period, CAST(ts AS DATE) AS day, CAST(floor(value / 50) AS BIGINT) AS amt, event_type = 'purchase' AS opens FROM events WHERE event_type IN ('purchase', 'error')"""
STACK_SQL = f"""WITH e AS ({EV_SQL}), o AS (SELECT *, CASE WHEN opens THEN 0 ELSE 1 END AS ph, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER w AS cum FROM e WINDOW w AS (PARTITION BY company_id, amt ORDER BY day, CASE WHEN opens THEN 0 ELSE 1 END, row_no)),
  m AS (SELECT *, least(0, min(cum) OVER w) AS mn, least(0, coalesce(min(cum) OVER (PARTITION BY company_id, amt ORDER BY day, ph, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS was FROM o WINDOW w AS (PARTITION BY company_id, amt ORDER BY day, ph, row_no)),
  l AS (SELECT *, CASE WHEN opens THEN cum - mn WHEN NOT (cum < was) THEN cum - mn + 1 END AS lvl FROM m),
  x AS (SELECT *, lag(row_no) OVER (PARTITION BY company_id, amt, lvl ORDER BY day, ph, row_no) AS mate, lag(day) OVER (PARTITION BY company_id, amt, lvl ORDER BY day, ph, row_no) AS mate_day FROM l WHERE lvl IS NOT NULL)"""


def federal(spark, d) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    status = F.when(F.col("event_type") == "purchase", "Settled").otherwise("Returned")
    return e.select(
        F.col("user_id").alias("company_id"), F.lit("all").alias("period"), F.col("event_id").alias("row_no"), F.to_date("ts").alias("settlement_date"),
        F.lit(None).cast("date").alias("initiation_date"), F.floor(F.col("value") / 50).cast("decimal(18,2)").alias("amount"), status.alias("status"),
    )


@query(
    "return_cancel",
    f"{STACK_SQL} SELECT l.company_id, l.row_no, l.amt AS amount, x.mate AS cancelled_row, x.mate_day AS cancelled_date, CASE WHEN x.mate IS NULL THEN 'NOT_FOUND' ELSE 'Returned' END AS cancelled_status FROM l LEFT JOIN x ON l.row_no = x.row_no WHERE NOT l.opens",
)
def return_cancel(spark, d):
    _, returns = rc.cancel_returned_payments(federal(spark, d), KEY)
    return returns.select("company_id", "row_no", whole("amount"), "cancelled_row", "cancelled_date", "cancelled_status")


@query(
    "return_repaid",
    f"""{STACK_SQL}, eff AS (SELECT company_id, amt, max(day) AS last FROM e WHERE opens AND row_no NOT IN (SELECT mate FROM x WHERE NOT opens) GROUP BY ALL)
    SELECT e.company_id, e.row_no, coalesce(last > day, FALSE) AS repaid FROM e LEFT JOIN eff USING (company_id, amt) WHERE NOT opens""",
)
def return_repaid(spark, d):
    effective, returns = rc.cancel_returned_payments(federal(spark, d), KEY)
    return rc.returns_repaid(returns, effective, KEY).select("company_id", "row_no", "repaid")


def split_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Rows whose two parts are printed as separate payments for most of them."""
    ws = worksheet(spark, d).withColumnRenamed("total", "edd_total")
    half = (F.floor(F.col("edd_total") / 2000) * 1000).cast("decimal(18,2)")
    ws = ws.withColumn("ui_ett", half).withColumn("p_i", (F.col("edd_total") - half).cast("decimal(18,2)"))
    k = F.col("row_no") % 4
    parts = F.when(k == 0, F.array("edd_total")).when(k == 1, F.array("ui_ett", "p_i")).when(k == 2, F.array("ui_ett")).otherwise(F.array("p_i", "ui_ett"))
    pay = ws.select(*KEY, (F.col("row_no") * 2).alias("row_no"), F.col("date").alias("pay_date"), F.posexplode(parts).alias("i", "amount"))
    return ws, pay.withColumn("row_no", F.col("row_no") + F.col("i")).drop("i")


@query("split_pairs")
def split_pairs(spark, d):
    """Greedy use of a shared pool; checked against a sequential loop in the tests."""
    ws, pay = split_inputs(spark, d)
    out = rc.match_split_pairs(rc.match_direct(ws, pay, KEY), pay, KEY)
    return out.select("company_id", "period", "row_no", "direct", "split")


@query(
    "residual_report",
    f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY company_id, period, t ORDER BY row_no) AS rn FROM ({WS_SQL})), p AS (SELECT *, row_number() OVER (PARTITION BY company_id, period, t ORDER BY row_no) AS rn FROM ({PAY_SQL})),
    wn AS (SELECT company_id, period, t, count(*) AS n FROM w GROUP BY ALL), pn AS (SELECT company_id, period, t, count(*) AS n FROM p GROUP BY ALL)
    SELECT company_id, period, 'missing' AS side, date, t AS amount FROM w LEFT JOIN pn USING (company_id, period, t) WHERE rn > coalesce(n, 0) AND t <> 0
    UNION ALL SELECT company_id, period, 'unexpected', date, t FROM p LEFT JOIN wn USING (company_id, period, t) LEFT JOIN pn USING (company_id, period, t) WHERE p.rn <= pn.n - least(coalesce(wn.n, 0), pn.n)""",
)
def residual_report(spark, d):
    ws = worksheet(spark, d).withColumnRenamed("total", "edd_total")
    none = F.lit(None).cast("decimal(18,2)")
    ws = ws.withColumns({"ui_ett": none, "p_i": none, "split": F.lit(False)})
    pay = payments(spark, d)
    return rc.residual_report(rc.match_direct(ws, pay, KEY), pay, KEY).select(*KEY, "side", "date", whole("amount"))


@query(
    "totals_agree",
    f"""WITH w AS (SELECT company_id, period, sum(t) AS w FROM ({WS_SQL}) GROUP BY ALL), p AS (SELECT company_id, period, sum(t) AS p FROM ({PAY_SQL}) GROUP BY ALL),
    off AS (SELECT DISTINCT company_id, period FROM (SELECT company_id, period, t, sum(s) AS s FROM (SELECT company_id, period, t, 1 AS s FROM ({WS_SQL}) WHERE t <> 0 UNION ALL SELECT company_id, period, t, -1 FROM ({PAY_SQL})) GROUP BY ALL) WHERE s <> 0)
    SELECT company_id, period, coalesce(w, 0) = coalesce(p, 0) AND (company_id, period) NOT IN (SELECT (company_id, period) FROM off) AS agree FROM w FULL OUTER JOIN p USING (company_id, period)""",
)
def totals_agree(spark, d):
    ws = worksheet(spark, d).withColumnRenamed("total", "edd_total")
    return rc.edd_totals_agree(ws, payments(spark, d), KEY, strict=True)


@query("reconcile_all")
def reconcile_all(spark, d):
    """The whole check in one result, one verdict per company and period."""
    ws, pay = split_inputs(spark, d)
    ws = ws.withColumn("total", F.col("edd_total"))
    p = payments(spark, d)
    status = F.when(F.col("row_no") % 17 == 0, "Returned").otherwise("Settled")
    fed = p.withColumn("status", status).withColumn("initiation_date", F.lit(None).cast("date")).drop("pay_date")
    return rc.reconcile(ws, fed, pay, KEY)
