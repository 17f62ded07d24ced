"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import cents, cents_sql, orders, query, table
from ledgerloom.functions import dates, ids, labels, money, payroll_text, text

SUFFIX_SQL = ", ".join(f"'{s}'" for s in text.CORPORATE_SUFFIXES)


def norm_sql(x: str) -> str:
    s = rf"regexp_replace(upper({x}), '[A-Z0-9]*[0-9]{{4}}[A-Z0-9]*[^A-Z0-9]*$', '')"
    s = f"regexp_replace(replace({s}, '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')"
    return f"array_to_string(list_filter(string_split({s}, ' '), lambda w: w <> '' AND w NOT IN ({SUFFIX_SQL})), ' ')"


@query(
    "vendor_text",
    f"""SELECT p_partkey, {norm_sql("p_name || ' & ' || p_brand || ' Inc. co#' || p_type || ' X' || (p_partkey * 7)")} AS norm FROM part""",
)
def vendor_text(spark, d):
    raw = F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" Inc. co#"), "p_type", F.lit(" X"), F.col("p_partkey") * 7)
    return table(spark, d, "part").select("p_partkey", text.normalize_vendor_text(raw).alias("norm"))


@query(
    "name_keys",
    """SELECT c_custkey,
      lower(regexp_replace(regexp_replace(trim(' ' || c_name || ' & Co. '), '\\s+', '_', 'g'), '[^A-Za-z0-9_]+', '', 'g')) AS slug,
      regexp_replace(lower(c_name || ' & Co.'), '[^a-z0-9]', '', 'g') AS compact,
      regexp_replace(c_name || ': Co', '[\\\\/:*?"<>|]', '_', 'g') || ' ' || lpad(CAST(c_nationkey % 12 + 1 AS VARCHAR), 2, '0')
        || ' ' || CAST(2000 + c_nationkey AS VARCHAR) || CASE WHEN c_acctbal < 0 THEN ' Withdrawal.csv' ELSE ' Deposit.csv' END AS file,
      c_mktsegment || CASE WHEN c_nationkey % 2 = 0 THEN ' M ' ELSE ' ' END || c_name || ' ("' || lower(c_mktsegment) || '")' AS person
    FROM customer""",
)
def name_keys(spark, d):
    co = F.concat("c_name", F.lit(" & Co."))
    month, year = F.col("c_nationkey") % 12 + 1, F.col("c_nationkey") + 2000
    direction = F.when(F.col("c_acctbal") < 0, "debits").otherwise("credits")
    middle = F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("")
    return table(spark, d, "customer").select(
        "c_custkey",
        text.slugify(F.concat(F.lit(" "), co, F.lit(" "))).alias("slug"),
        text.compact(co).alias("compact"),
        text.safe_filename(F.concat("c_name", F.lit(": Co")), month, year, direction).alias("file"),
        text.person_name(F.col("c_mktsegment"), middle, F.col("c_name"), F.lower("c_mktsegment")).alias("person"),
    )


@query(
    "tokenize_text",
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(lower(text)), '[^a-z0-9@._\-&]+'), lambda x: x <> '') AS tok FROM documents)
    SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tokens, md5(array_to_string(tok, ' ')) AS norm_md5 FROM t""",
)
def tokenize_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.tokenize("text").alias("tok"))
    return docs.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tok", " ")).alias("norm_md5"))


@query(
    "identity_keys",
    """WITH c AS (SELECT c_custkey, '(' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ') 555-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS phone,
        lpad(CAST(c_custkey * 37 AS VARCHAR), 9, '0') AS num, c_mktsegment = 'HOUSEHOLD' AS ind FROM customer)
    SELECT c_custkey, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone10, right(num, 9) AS ein9,
      CASE WHEN c_custkey % 5 = 0 THEN 'id-' || c_custkey WHEN ind THEN 'ssn:' || num ELSE 'ein:' || num END AS uid,
      CASE WHEN ind THEN 'ssn:' || num ELSE 'ein:' || num END AS canon FROM c""",
)
def identity_keys(spark, d):
    c = table(spark, d, "customer")
    num = F.lpad((F.col("c_custkey") * 37).cast("string"), 9, "0")
    dashed = F.concat(F.substring(num, 1, 2), F.lit("-"), F.substring(num, 3, 20))
    phone = F.concat(F.lit("("), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(") 555-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"))
    ind = F.col("c_mktsegment") == "HOUSEHOLD"
    ein, ssn = F.when(~ind, dashed).otherwise(""), F.when(ind, dashed).otherwise("")
    cid = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("id-"), F.col("c_custkey").cast("string"))).otherwise("")
    return c.select(
        "c_custkey", ids.phone10(phone).alias("phone10"), ids.ein9(dashed).alias("ein9"),
        ids.client_uid(cid, ind, ein, ssn).alias("uid"), ids.canonical_key(ind, ein, ssn).alias("canon"),
    )


@query(
    "role_tables",
    """WITH r AS (SELECT s_suppkey, s_nationkey % 2 = 0 AS a, s_suppkey % 2 = 0 AS b,
        list_extract(['parent','child','spouse','employee','owner',''], CAST(s_suppkey % 6 + 1 AS BIGINT)) AS role FROM supplier)
    SELECT s_suppkey, CASE role WHEN 'parent' THEN 'child' WHEN 'child' THEN 'parent' WHEN 'owner' THEN 'business' ELSE role END AS inverse,
      CASE WHEN NOT a AND b THEN CASE WHEN role = 'employee' THEN role ELSE 'business owner' END
           WHEN a AND NOT b THEN 'business'
           WHEN a AND b THEN CASE WHEN role IN ('parent','child','spouse') THEN role ELSE 'relative' END
           ELSE CASE WHEN role = '' THEN 'business' ELSE role END END AS forward,
      CASE WHEN NOT a AND b THEN 'business' WHEN a AND NOT b THEN 'owner'
           WHEN a AND b THEN CASE role WHEN 'parent' THEN 'child' WHEN 'child' THEN 'parent' WHEN 'spouse' THEN role ELSE 'relative' END
           ELSE CASE WHEN role = '' THEN 'business' ELSE role END END AS backward FROM r""",
)
def role_tables(spark, d):
    roles = F.array(*[F.lit(x) for x in ("parent", "child", "spouse", "employee", "owner", "")])
    role = F.element_at(roles, (F.col("s_suppkey") % 6 + 1).cast("int"))
    fwd, back = ids.link_roles(F.col("s_nationkey") % 2 == 0, F.col("s_suppkey") % 2 == 0, role)
    return table(spark, d, "supplier").select("s_suppkey", ids.inverse_role(role).alias("inverse"), fwd.alias("forward"), back.alias("backward"))


@query("money_text", f"SELECT o_orderkey, {cents_sql('o_totalprice')} * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END AS cents, {cents_sql('o_totalprice')} AS worksheet FROM orders")
def money_text(spark, d):
    shown = F.format_number("o_totalprice", 2)
    k = F.col("o_orderkey") % 3
    printed = F.when(k == 0, F.concat(F.lit("$"), shown)).when(k == 1, F.concat(shown, F.lit("-"))).otherwise(F.concat(F.lit("- $ "), shown))
    return table(spark, d, "orders").select(
        "o_orderkey", cents(money.money_parse(printed)).alias("cents"), cents(money.worksheet_money(shown)).alias("worksheet")
    )


@query(
    "date_text",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed,
      CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q_start,
      CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS q_end,
      CAST(quarter(CAST(date_trunc('quarter', o_orderdate) AS DATE) - INTERVAL 1 DAY) AS BIGINT) AS prev_q FROM orders""",
)
def date_text(spark, d):
    o = orders(spark, d)
    forms = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yy", "MM-dd-yyyy", "MM.dd.yy", "dd-MMM-yyyy", "dd-MMM-yy", "yyyyMMdd")
    k = F.col("o_orderkey") % len(forms)
    printed = F.date_format("day", forms[-1])
    for i, f in enumerate(forms[:-1]):
        printed = F.when(k == i, F.date_format("day", f)).otherwise(printed)
    start, end = dates.quarter_range(F.year("day"), F.quarter("day"))
    return o.select(
        "o_orderkey", dates.date_parse(printed).alias("parsed"), dates.quarter_start("day").alias("q_start"), end.alias("q_end"),
        dates.previous_quarter("day")[1].cast("bigint").alias("prev_q"),
    )


@query(
    "next_dates",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderkey % 31 + 1 AS INT) AS dom, CAST(o_orderkey % 13 + 5 AS INT) AS dom2 FROM orders),
    m AS (SELECT o.*, k, CAST(date_trunc('month', s) AS DATE) + to_months(CAST(k AS INT)) AS f FROM o, range(0, 16) r(k)),
    c AS (SELECT *, CAST(f AS DATE) + CAST(least(dom, day(last_day(f))) - 1 AS INT) AS d1, CAST(f AS DATE) + CAST(least(dom2, day(last_day(f))) - 1 AS INT) AS d2 FROM m)
    SELECT o_orderkey, min(CASE WHEN d1 >= s THEN d1 END) AS monthly,
      least(min(CASE WHEN d1 >= s THEN d1 END), min(CASE WHEN d2 >= s THEN d2 END)) AS semi,
      min(CASE WHEN d1 >= s AND month(f) IN (1,4,7,10) THEN d1 END) AS quarterly FROM c GROUP BY o_orderkey""",
)
def next_dates(spark, d):
    o = orders(spark, d)
    dom, dom2 = (F.col("o_orderkey") % 31 + 1).cast("int"), (F.col("o_orderkey") % 13 + 5).cast("int")
    none = F.array().cast("array<int>")
    return o.select(
        "o_orderkey", dates.next_monthly(F.col("day"), dom).alias("monthly"),
        dates.next_semi_monthly(F.col("day"), dom, dom2).alias("semi"), dates.next_quarterly(F.col("day"), none, dom).alias("quarterly"),
    )


@query(
    "printed_fields",
    """SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS check_date, CAST(o_orderkey + 100 AS VARCHAR) AS check_number,
      lpad(CAST(o_orderkey % 900 + 2100 AS VARCHAR), 4, '0') AS last4,
      CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey % 900 + 2100 AS VARCHAR), 4, '0') END AS name4,
      CAST(month(o_orderdate) AS BIGINT) AS name_month FROM orders""",
)
def printed_fields(spark, d):
    o = orders(spark, d)
    four = F.lpad((F.col("o_orderkey") % 900 + 2100).cast("string"), 4, "0")
    note = F.concat(F.lit("Pay to "), F.date_format("day", "M/d/yy"), F.lit(" Check #"), (F.col("o_orderkey") + 100).cast("string"))
    file = F.concat(F.lit("/in/"), F.date_format("day", "yyyy-MM-dd"), F.lit("_visa-"), F.when(F.col("o_orderkey") % 2 == 0, four).otherwise("x"), F.lit(".xlsx"))
    f = text.check_fields(note)
    return o.select(
        "o_orderkey", f["check_date"].alias("check_date"), f["check_number"].alias("check_number"),
        text.last4_from_text(F.concat(F.lit("Credit Card No: "), four)).alias("last4"), text.last4_from_name(file).alias("name4"),
        text.month_year_from_name(file)[0].cast("bigint").alias("name_month"),
    )


@query(
    "merchant_location",
    """WITH p AS (SELECT p_partkey, upper(p_name) AS n, CASE p_partkey % 3 WHEN 0 THEN 'SF' WHEN 1 THEN 'BERKELEY' ELSE 'L.A' END AS city,
        CASE WHEN p_partkey % 4 = 0 THEN 'XX' ELSE 'CA' END AS st FROM part)
    SELECT p_partkey, CASE WHEN st = 'XX' THEN n || ' ' || city || ' XX' WHEN city = 'BERKELEY' THEN n || ' BERKELEY' ELSE n END AS merchant,
      CASE WHEN st = 'XX' OR city = 'BERKELEY' THEN '' ELSE city END AS city, CASE WHEN st = 'XX' THEN '' ELSE st END AS state FROM p""",
)
def merchant_location(spark, d):
    k = F.col("p_partkey")
    city = F.when(k % 3 == 0, "SF").when(k % 3 == 1, "BERKELEY").otherwise("L.A")
    line = F.concat_ws(" ", F.upper("p_name"), city, F.when(k % 4 == 0, "XX").otherwise("CA"))
    return table(spark, d, "part").select("p_partkey", *[v.alias(n) for n, v in text.merchant_location(line).items()])


@query(
    "labels_and_tags",
    """WITH o AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' ELSE 'Waiting on Client' END AS st, DATE '1998-06-30' - CAST(o_orderdate AS DATE) AS age FROM orders)
    SELECT o_orderkey, CASE st WHEN 'Open' THEN 'tr_open' WHEN 'Closed' THEN 'tr_closed' ELSE 'tr_waiting' END AS tag,
      CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 4 = 0 THEN 'todo,submission' WHEN age >= -3 THEN 'todo,due' ELSE 'todo' END AS tags,
      CAST(o_orderkey % 3 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ' Payroll Tax' ELSE ' Payroll Taxes' END AS plural,
      CAST(o_orderkey % 3 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ' Entry' ELSE ' Entries' END AS plural_y,
      list_extract(['Payroll','SOI','Workers Comp'], CAST(o_orderkey % 3 + 1 AS BIGINT)) AS kind FROM o""",
)
def labels_and_tags(spark, d):
    o = orders(spark, d)
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "O", "Open").when(s == "F", "Closed").otherwise("Waiting on Client")
    n = (k % 3 + 1).cast("int")
    kind = F.element_at(F.array(F.lit("PAYROLL"), F.lit("STATEMENT OF INFORMATION"), F.lit("WORKERS_COMP")), n)
    tags = labels.occurrence_tags(F.col("day"), s == "F", F.lit("1998-06-30").cast("date"), F.lit(""), F.when(k % 4 == 0, 2).otherwise(0))
    return o.select(
        "o_orderkey", labels.status_tag("issue", status).alias("tag"), F.array_join(tags, ",").alias("tags"),
        labels.plural_label(F.lit("Payroll Tax"), n).alias("plural"), labels.plural_label(F.lit("Entry"), n).alias("plural_y"), labels.task_label(kind).alias("kind"),
    )


@query(
    "history_and_notes",
    """WITH c AS (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS flat, role FROM conversations)
    SELECT conv_id, turn, role AS head, 'part | two' AS tail, '2024-01-02 03:04' AS minute,
      CASE WHEN length(flat) > 30 THEN substr(flat, 1, 27) || '...' ELSE flat END AS preview,
      CASE WHEN turn = 0 THEN role ELSE 'old' || chr(10) || chr(10) || role END AS note FROM c""",
)
def history_and_notes(spark, d):
    c = table(spark, d, "conversations")
    head, tail = text.split_history_text(F.concat("role", F.lit(" | part | two")))
    return c.select(
        "conv_id", "turn", head.alias("head"), tail.alias("tail"), text.norm_minute(F.lit("2024-01-02T03:04:05Z")).alias("minute"),
        text.preview("text", 30).alias("preview"), text.note_append(F.when(F.col("turn") == 0, "").otherwise("old"), F.col("role")).alias("note"),
    )


@query(
    "file_name_edits",
    """SELECT p_partkey, CASE WHEN p_size >= length(p_name) THEN right(p_name, 1) ELSE substr(p_name, p_size + 1) END AS front,
      CASE WHEN p_size >= length(p_name) THEN left(p_name, 1) ELSE substr(p_name, 1, length(p_name) - p_size) END AS back, 'A_' || p_name || '_Z' AS affixed FROM part""",
)
def file_name_edits(spark, d):
    base, n = F.col("p_name"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", text.trim_name(base, "front", n).alias("front"), text.trim_name(base, "end", n).alias("back"), text.affix_name(base, "A_", "_Z").alias("affixed")
    )


@query(
    "wage_names",
    """WITH p AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part),
    t AS (SELECT p_partkey, upper(a[1]) || substr(a, 2) AS a, upper(b[1]) || substr(b, 2) AS b FROM p)
    SELECT p_partkey, a AS first_name, CASE WHEN p_partkey % 3 = 0 THEN 'Q' ELSE '' END AS middle_initial,
      b || '-' || a || CASE WHEN p_partkey % 2 = 1 THEN ' JR' ELSE '' END AS last_name,
      p_partkey % 2 = 0 AS plausible, p_partkey % 5 = 0 AS page_total, CASE WHEN p_partkey % 2 = 0 THEN 'O' ELSE 'R' END AS wage_type FROM t""",
)
def wage_names(spark, d):
    k = F.col("p_partkey")
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    mi = F.when(k % 3 == 0, "q.")
    last = F.concat(b, F.lit("-"), a)
    line = F.when(k % 2 == 1, F.concat_ws(" ", a, mi, last, F.lit("jr."))).otherwise(F.concat(last, F.lit(", "), F.concat_ws(" ", a, mi)))
    parts = payroll_text.wage_name_split(F.upper(line), "NY")
    plausible = payroll_text.wage_amounts_plausible(F.lit(100), F.when(k % 2 == 0, 90).otherwise(110), F.lit(5))
    total = payroll_text.looks_like_page_total(F.lit(30000), F.when(k % 5 == 0, 30000).otherwise(1))
    return table(spark, d, "part").select(
        "p_partkey", *[v.alias(n) for n, v in parts.items()], plausible.alias("plausible"), total.alias("page_total"),
        payroll_text.wage_type(F.when(k % 2 == 0, "o").otherwise("x")).alias("wage_type"),
    )


@query(
    "payroll_phrases",
    f"""SELECT o_orderkey, CAST(o_orderkey % 40 AS BIGINT) * 100 AS sick, CASE WHEN o_orderkey % 2 = 0 THEN -{cents_sql('o_totalprice')} ELSE 0 END AS advance,
      {cents_sql('o_totalprice')} AS bonus FROM orders""",
)
def payroll_phrases(spark, d):
    o = orders(spark, d)
    shown = F.format_number("o_totalprice", 2)
    k = F.col("o_orderkey")
    line = F.concat_ws(" ", F.lit("Sick"), (k % 40).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("빌려간돈 "), shown, F.lit(" 빼고"))), F.lit("보너스"), shown)
    return o.select("o_orderkey", *[cents(v).alias(n) for n, v in payroll_text.payroll_phrases(line).items()])
