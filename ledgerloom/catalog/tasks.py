"""Calendar and recurring-task queries: every order is a task whose rule follows from its key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import orders, query, table
from ledgerloom.operators import calendar as cal
from ledgerloom.operators import tasks as tk

TODAY = dt.date(1998, 6, 17)
# Most tasks act up to three days ahead, some five, some half a year and some more than a year.
LEAD_SQL = "CASE o_orderkey % 25 WHEN 7 THEN 120 WHEN 8 THEN 5 WHEN 9 THEN 400 ELSE o_orderkey % 4 END"

HOLIDAY_SQL = """(month(d) = 1 AND day(d) = 1) OR (month(d) = 6 AND day(d) = 19) OR (month(d) = 7 AND day(d) = 4) OR (month(d) = 11 AND day(d) = 11) OR (month(d) = 12 AND day(d) = 25)
  OR (isodow(d) = 1 AND ((month(d) = 1 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 2 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND day(d) > 24) OR (month(d) = 9 AND day(d) <= 7) OR (month(d) = 10 AND day(d) BETWEEN 8 AND 14)))
  OR (isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28)"""
CAL_SQL = f"""days AS (SELECT CAST(unnest(generate_series(DATE '1985-01-01', DATE '2006-12-31', INTERVAL 1 DAY)) AS DATE) AS d), cal0 AS (SELECT d, isodow(d) <= 5 AND NOT ({HOLIDAY_SQL}) AS bd FROM days),
  cal AS (SELECT d, bd, CAST(sum(CASE WHEN bd THEN 1 ELSE 0 END) OVER (ORDER BY d) AS BIGINT) AS idx FROM cal0), bds AS (SELECT d AS bday, idx FROM cal WHERE bd)"""
TASK_SQL = f"""t AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS start_on, o_orderpriority[1] AS p, CAST(o_orderkey % 31 + 1 AS INT) AS dom, CAST(o_orderkey % 13 + 5 AS INT) AS dom2, CAST({LEAD_SQL} AS INT) AS lead,
  o_orderkey % 9 = 0 AS paused, CAST(o_orderdate AS DATE) + 200 AS pause_from, CASE WHEN o_orderkey % 9 = 1 THEN CAST(o_orderdate AS DATE) + 400 END AS resume_from, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 900 END AS end_on, o_orderkey % 20 <> 0 AS enabled, o_orderkey FROM orders)"""


def occ_sql(lo: str, hi: str) -> str:
    """(id, orig, disp) of all days in [lo, hi] by testing every day of the window."""
    clamp = "least({}, day(last_day(d)))"
    dom, dom2 = clamp.format("dom"), clamp.format("dom2")
    return f"""{CAL_SQL}, {TASK_SQL}, w AS (SELECT t.*, d AS orig FROM t, days WHERE d BETWEEN DATE '{lo}' AND DATE '{hi}' AND d >= start_on AND (end_on IS NULL OR d <= end_on)
      AND NOT (paused AND d >= pause_from) AND NOT (resume_from IS NOT NULL AND d >= pause_from AND d < resume_from)
      AND CASE p WHEN '1' THEN day(d) = {dom} WHEN '2' THEN day(d) IN ({dom}, {dom2}) WHEN '3' THEN (d - start_on) % 7 = 0 WHEN '4' THEN (d - start_on) % 14 = 0 AND isodow(d) = isodow(start_on) ELSE month(d) IN (1, 4, 7, 10) AND day(d) = {dom} END),
    occ AS (SELECT w.*, b.bday AS disp FROM w JOIN cal c ON c.d = w.orig JOIN bds b ON b.idx = c.idx - lead),
    occs AS (SELECT *, day(orig) % 2 = 0 AND id % 3 = 0 AS is_done, day(orig) % 2 = 1 AND id % 3 = 1 AS is_cancelled FROM occ)"""


def task_table(spark, d, states: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    o = orders(spark, d)
    k, p, day = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1), F.col("day")
    freq = F.when(p == "1", "monthly").when(p == "2", "semi-monthly").when(p == "3", "weekly").when(p == "4", "biweekly").otherwise("quarterly")
    none = F.array().cast("array<date>")
    bags = {"completed": none, "cancelled": none}
    if states:
        span = F.sequence(F.lit(states[0]), F.lit(states[1]))
        bags["completed"] = F.when(k % 3 == 0, F.filter(span, lambda x: F.dayofmonth(x) % 2 == 0)).otherwise(none)
        bags["cancelled"] = F.when(k % 3 == 1, F.filter(span, lambda x: F.dayofmonth(x) % 2 == 1)).otherwise(none)
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("client_idx"), F.concat(F.lit("Client "), F.col("o_custkey").cast("string")).alias("client_name"),
        F.when(k % 2 == 0, "OTHER").otherwise("PAYROLL").alias("kind"), F.when(k % 4 == 0, "Audit").otherwise("").alias("kind_other"),
        freq.alias("freq"), (k % 31 + 1).cast("int").alias("dom"), (k % 13 + 5).cast("int").alias("dom2"),
        F.when(p == "4", F.weekday(day)).cast("int").alias("weekday"), day.alias("anchor_date"), F.array().cast("array<int>").alias("months"),
        day.alias("start_on"), F.lit(None).cast("date").alias("effective_from"), F.when(k % 6 == 0, F.date_add(day, 900)).alias("end_on"),
        F.date_add(day, 200).alias("pause_from"), F.when(k % 9 == 1, F.date_add(day, 400)).alias("resume_from"), (k % 9 == 0).alias("is_paused"),
        (k % 20 != 0).alias("is_enabled"), F.lit(None).cast("date").alias("due"), F.expr(LEAD_SQL).cast("int").alias("action_lead_days"), F.lit("").alias("method"),
        *[v.alias(c) for c, v in bags.items()],
    )


@query(
    "biz_calendar",
    f"WITH {CAL_SQL} SELECT o_orderkey, bday AS rolled FROM orders JOIN cal ON d = CAST(o_orderdate AS DATE) JOIN bds USING (idx)",
)
def biz_calendar(spark, d):
    o = orders(spark, d).select("o_orderkey", "day")
    return cal.roll_back(o, "day", "rolled").select("o_orderkey", "rolled")


@query(
    "shift_bd",
    f"""WITH {CAL_SQL}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 50 WHEN 1 THEN 400 WHEN 2 THEN -400 WHEN 3 THEN 120 ELSE o_orderkey % 21 - 10 END AS n FROM orders)
    SELECT o_orderkey, n, CASE WHEN n = 0 THEN day ELSE bday END AS shifted FROM o JOIN cal ON d = day JOIN bds b ON b.idx = cal.idx + n + CASE WHEN n < 0 AND NOT bd THEN 1 ELSE 0 END""",
)
def shift_bd(spark, d):
    o = orders(spark, d).select("o_orderkey", "day", F.expr("CASE o_orderkey % 50 WHEN 1 THEN 400 WHEN 2 THEN -400 WHEN 3 THEN 120 ELSE o_orderkey % 21 - 10 END").alias("n"))
    return cal.shift_business_days(o, "day", "n", "shifted").select("o_orderkey", "n", "shifted")


@query("occurrences", f"WITH {occ_sql('1998-05-22', '1998-07-10')} SELECT id, orig, disp FROM occ")
def occurrences(spark, d):
    return tk.expand_occurrences(task_table(spark, d), dt.date(1998, 6, 1), dt.date(1998, 6, 30)).select("id", "orig", "disp")


@query(
    "calendar_badges",
    f"""WITH {occ_sql('1998-05-22', '1998-07-13')} SELECT disp, count(*) FILTER (WHERE NOT is_done AND NOT is_cancelled) AS todo, count(*) FILTER (WHERE is_done OR is_cancelled) AS closed
    FROM (SELECT disp, enabled, (day(orig) % 2 = 0 OR day(disp) % 2 = 0) AND id % 3 = 0 AS is_done, (day(orig) % 2 = 1 OR day(disp) % 2 = 1) AND id % 3 = 1 AS is_cancelled FROM occ) WHERE enabled AND disp BETWEEN DATE '1998-06-01' AND DATE '1998-06-30' GROUP BY disp""",
)
def calendar_badges(spark, d):
    tasks = task_table(spark, d, (dt.date(1998, 5, 1), dt.date(1998, 7, 31)))
    return tk.calendar_badges(tk.calendar_month(tasks, 1998, 6))


FEED_SQL = """occs2 AS (SELECT *, (day(orig) % 2 = 0 OR day(disp) % 2 = 0) AND id % 3 = 0 AS dn, (day(orig) % 2 = 1 OR day(disp) % 2 = 1) AND id % 3 = 1 AS cn FROM occ WHERE enabled),
  past AS (SELECT id, orig, disp, dn, cn FROM occs2 WHERE orig <= DATE '1998-06-26' AND disp BETWEEN DATE '1998-06-10' AND DATE '1998-06-24'),
  up AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY disp, orig) AS rn FROM occs2 WHERE orig >= DATE '1998-06-07' AND disp BETWEEN DATE '1998-06-17' AND DATE '1998-06-24'),
  nxt AS (SELECT id, orig, disp, dn, cn FROM up WHERE rn = 1 UNION ALL SELECT id, orig, disp, dn, cn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY disp, orig) AS r2 FROM up WHERE rn > 1 AND NOT dn) WHERE r2 = 1)"""


@query(
    "next_due",
    f"WITH {occ_sql('1998-05-31', '1998-07-04')}, {FEED_SQL} SELECT id, orig, disp FROM nxt",
)
def next_due(spark, d):
    tasks = task_table(spark, d, (dt.date(1998, 5, 1), dt.date(1998, 7, 31))).filter("is_enabled")
    occ = tk.expand_occurrences(tasks, dt.date(1998, 6, 10), dt.date(1998, 6, 24)).filter(F.col("orig") >= F.lit(dt.date(1998, 6, 7)))
    return tk.next_occurrences(occ, TODAY, dt.date(1998, 6, 24)).select("id", "orig", "disp")


@query(
    "todo_feed",
    f"""WITH {occ_sql('1998-05-31', '1998-07-04')}, {FEED_SQL} SELECT DISTINCT id, orig, disp, CASE WHEN cn THEN '×' WHEN dn THEN 'v' ELSE 'ㅁ' END AS mark,
      CASE WHEN cn THEN 'done,cancelled' WHEN dn THEN 'done' WHEN {LEAD_SQL.replace('o_orderkey', 'id')} > 0 THEN 'todo,submission' WHEN disp <= DATE '1998-06-20' THEN 'todo,due' ELSE 'todo' END AS tags FROM (SELECT * FROM past UNION ALL SELECT * FROM nxt)""",
)
def todo_feed(spark, d):
    tasks = task_table(spark, d, (dt.date(1998, 5, 1), dt.date(1998, 7, 31)))
    feed = tk.sort_todo(tk.todo_feed(tasks, TODAY))
    return feed.select("id", "orig", "disp", "mark", F.array_join("tags", ",").alias("tags"))


@query(
    "client_task_feed",
    f"""WITH {occ_sql('1998-06-05', '1998-07-06')}, o2 AS (SELECT *, day(orig) % 2 = 0 AND id % 3 = 0 AS dn FROM occ),
    past AS (SELECT id, disp, orig FROM o2 WHERE orig <= DATE '1998-06-21' AND disp >= DATE '1998-06-10' AND disp < DATE '1998-06-17'),
    up AS (SELECT *, row_number() OVER w AS rn, first_value(dn) OVER w AS fd FROM o2 WHERE orig >= DATE '1998-06-12' AND disp BETWEEN DATE '1998-06-17' AND DATE '1998-07-01' WINDOW w AS (PARTITION BY id ORDER BY disp, orig)),
    nxt AS (SELECT id, disp, orig FROM up WHERE rn = 1 UNION ALL SELECT id, disp, orig FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY disp, orig) AS r2 FROM up WHERE rn > 1 AND fd AND NOT dn) WHERE r2 = 1)
    SELECT id, disp, min(orig) AS orig FROM (SELECT * FROM past UNION ALL SELECT * FROM nxt) GROUP BY id, disp""",
)
def client_task_feed(spark, d):
    tasks = task_table(spark, d, (dt.date(1998, 5, 1), dt.date(1998, 7, 31)))
    return tk.client_task_feed(tasks, TODAY).select("id", "disp", "orig")


@query(
    "pause_start",
    f"""WITH {occ_sql('1995-01-01', '2003-12-31')}, c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN DATE '1998-06-10' ELSE CAST(o_orderdate AS DATE) END AS since FROM orders)
    SELECT c.id, min(orig) AS pause_from FROM c LEFT JOIN w ON w.id = c.id AND orig >= since GROUP BY c.id""",
)
def pause_start(spark, d):
    closed = F.when(F.col("id") % 2 == 0, F.array(F.lit(dt.date(1998, 6, 9)))).otherwise(F.array().cast("array<date>"))
    return task_table(spark, d).withColumn("completed", closed).select("id", tk.pause_start(TODAY).alias("pause_from"))


@query(
    "batch_pause_resume",
    """SELECT o_orderkey AS id, o_custkey % 4 = 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 20 <> 0 AND o_orderkey % 9 <> 0 AS paused,
      o_custkey % 4 = 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 9 = 0 AS resumed FROM orders""",
)
def batch_pause_resume(spark, d):
    tasks = task_table(spark, d)
    c = table(spark, d, "customer").filter(F.col("c_custkey") % 4 == 0)
    # Half of the clients are known by position only, the other half by name only.
    by_name = F.col("c_custkey") % 8 == 0
    clients = c.select(F.when(~by_name, F.col("c_custkey")).alias("client_idx"), F.when(by_name, F.concat(F.lit("client "), F.col("c_custkey").cast("string"))).otherwise("").alias("name"))
    a = tk.batch_pause(tasks, clients, TODAY).select("id", F.col("changed").alias("paused"))
    b = tk.batch_resume(tasks, clients, TODAY).select("id", F.col("changed").alias("resumed"))
    return a.join(b, "id")


@query(
    "split_series",
    """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderkey % 31 + 1 AS INT) AS dom, CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 900 END AS e FROM orders)
    SELECT id, s AS start_on, e AS end_on, dom FROM o WHERE id % 3 <> 0 UNION ALL SELECT id, DATE '1998-01-01', e, 9 FROM o WHERE id % 3 = 0 AND s >= DATE '1998-01-01'
    UNION ALL SELECT id, s, DATE '1997-12-31', dom FROM o WHERE id % 3 = 0 AND s < DATE '1998-01-01' UNION ALL SELECT id + 10000000, DATE '1998-01-01', CASE WHEN e >= DATE '1998-01-01' THEN e END, 9 FROM o WHERE id % 3 = 0 AND s < DATE '1998-01-01'""",
)
def split_series(spark, d):
    tasks = task_table(spark, d)
    day = F.lit(dt.date(1998, 1, 1))
    new = F.struct(day.alias("start_on"), F.col("end_on"), F.lit(9).alias("dom"))
    edits = tasks.filter(F.col("id") % 3 == 0).select("id", day.alias("effective_from"), new.alias("new"), (F.col("id") + 10000000).alias("new_id"))
    return tk.split_series(tasks, edits).select("id", "start_on", "end_on", "dom")


@query(
    "occurrence_states",
    f"""WITH {CAL_SQL}, o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, {LEAD_SQL} AS lead FROM orders), x AS (SELECT o.*, bday AS disp FROM o JOIN cal ON d = day JOIN bds b ON b.idx = cal.idx - lead)
    SELECT id, CASE WHEN id % 5 IN (1, 3) THEN CASE WHEN day = disp THEN CAST(day AS VARCHAR) ELSE least(day, disp) || ',' || greatest(day, disp) END ELSE '' END AS completed,
      CASE WHEN id % 5 = 2 THEN CASE WHEN day = disp THEN CAST(day AS VARCHAR) ELSE least(day, disp) || ',' || greatest(day, disp) END ELSE '' END AS cancelled FROM x""",
)
def occurrence_states(spark, d):
    tasks = task_table(spark, d)
    k = F.col("id") % 5
    # 0 todo, 1 done, 2 cancel a finished day, 3 toggle on, 4 toggle a finished day off.
    tasks = tasks.withColumn("completed", F.when(k.isin(0, 2, 4), F.array("start_on")).otherwise(F.array().cast("array<date>")))
    state = F.when(k == 0, "todo").when(k == 1, "done").when(k == 2, "cancel").otherwise("toggle_done")
    edits = tasks.select("id", F.col("start_on").alias("orig"), state.alias("state"))
    out = tk.set_occurrence_state(tasks, edits)
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",").alias(c)
    return out.select("id", text("completed"), text("cancelled"))


@query(
    "task_overview",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 AND CAST(o_orderdate AS DATE) + 900 < DATE '1998-06-17' THEN 'Stopped' WHEN o_orderkey % 9 = 0 THEN 'Paused' ELSE 'In progress' END AS state,
      'Recurring (' || list_extract(['monthly', 'semi-monthly', 'weekly', 'biweekly', 'quarterly'], CAST(o_orderpriority[1] AS BIGINT)) || ')' AS schedule, CASE WHEN o_orderkey % 4 = 0 THEN 'Audit' WHEN o_orderkey % 2 = 0 THEN 'OTHER' ELSE 'PAYROLL' END AS kind_label,
      CASE CAST(o_orderpriority[1] AS INT) WHEN 3 THEN DATE '1998-06-15' WHEN 4 THEN DATE '1998-06-15' ELSE DATE '1998-06-01' END AS anchor FROM orders""",
)
def task_overview(spark, d):
    tasks = task_table(spark, d)
    out = tk.task_overview(tasks, TODAY)
    anchor = tasks.select("id", tk.default_anchor(F.col("freq"), TODAY).alias("anchor"))
    return out.join(anchor, "id").select("id", "state", "schedule", "kind_label", "anchor")
