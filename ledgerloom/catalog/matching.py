"""Vendor, rule, account, card and payee matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import cents, cents_sql, money, orders, query, table
from ledgerloom.catalog.scalars import norm_sql
from ledgerloom.operators import cards, columns
from ledgerloom.operators import vendors as vd

# Transactions: line items described by their part; dictionary: the distinct part names.
TX_SQL = f"""SELECT l_orderkey, l_linenumber, upper(p_name) || ' ' || p_brand || ' #' || (l_orderkey + 10000) AS description,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * {cents_sql('l_extendedprice')} AS c, CAST(l_shipdate AS DATE) AS tx_date FROM lineitem JOIN part ON l_partkey = p_partkey"""


def transactions(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_shipdate")  # noqa: E741
    tx = l.join(p, l["l_partkey"] == p["p_partkey"])
    amount = F.when(F.col("l_returnflag") == "R", money("l_extendedprice")).otherwise(-money("l_extendedprice"))
    label = F.concat(F.upper("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" #"), (F.col("l_orderkey") + 10000).cast("string"))
    return tx.select("l_orderkey", "l_linenumber", label.alias("description"), amount.alias("amount"), F.to_date("l_shipdate").alias("tx_date"))


def vendor_sheet(spark, d) -> DataFrame:
    """Vendor rows from all part names, with one alias each."""
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("row_no"))
    alias = F.concat(F.element_at(F.split("p_name", " "), 2), F.lit(" Inc; "), F.lit(""))
    return p.select(F.col("p_name").alias("Vendor"), alias.alias("Aliases"), "row_no")


VENDORS_SQL = """SELECT p_name AS vendor, upper(p_name) AS norm, row_no, p_name AS synonym FROM (SELECT p_name, min(p_partkey) AS row_no FROM part GROUP BY p_name)
  UNION ALL SELECT p_name, upper(string_split(p_name, ' ')[2]), row_no, string_split(p_name, ' ')[2] || ' Inc' FROM (SELECT p_name, min(p_partkey) AS row_no FROM part GROUP BY p_name)"""
CONTAINS_SQL = f"""SELECT norm_text, arg_min(vendor, (-length(norm), row_no, synonym)) AS vendor FROM
  (SELECT DISTINCT {norm_sql('description')} AS norm_text FROM ({TX_SQL})) t JOIN ({VENDORS_SQL}) v ON contains(norm_text, norm) GROUP BY norm_text"""


@query(
    "vendor_dictionary",
    f"SELECT vendor, synonym, norm, CAST(length(norm) AS BIGINT) AS norm_len FROM ({VENDORS_SQL})",
)
def vendor_dictionary(spark, d):
    out = vd.build_vendor_dict(vendor_sheet(spark, d), "row_no")
    return out.select("vendor", "synonym", "norm", F.col("norm_len").cast("bigint").alias("norm_len"))


@query(
    "vendor_contains_match",
    f"SELECT l_orderkey, l_linenumber, coalesce(vendor, '') AS vendor FROM (SELECT *, {norm_sql('description')} AS n FROM ({TX_SQL})) LEFT JOIN ({CONTAINS_SQL}) ON n = norm_text",
)
def vendor_contains_match(spark, d):
    from ledgerloom.functions.text import normalize_vendor_text

    tx = transactions(spark, d).withColumn("norm_text", normalize_vendor_text("description"))
    dictionary = vd.build_vendor_dict(vendor_sheet(spark, d), "row_no")
    best = vd.match_vendor_contains(tx.select("norm_text").distinct(), dictionary)
    return tx.join(best, "norm_text", "left").select("l_orderkey", "l_linenumber", F.coalesce("contains_vendor", F.lit("")).alias("vendor"))


@query(
    "vendor_totals",
    f"""SELECT coalesce(vendor, '') AS vendor, CASE WHEN c < 0 THEN 'debits' ELSE 'credits' END AS direction, CAST(sum(c) AS BIGINT) AS cents, count(*) AS n
    FROM (SELECT *, {norm_sql('description')} AS n FROM ({TX_SQL})) LEFT JOIN ({CONTAINS_SQL}) ON n = norm_text GROUP BY 1, 2""",
)
def vendor_totals(spark, d):
    dictionary = vd.build_vendor_dict(vendor_sheet(spark, d), "row_no")
    matched = vd.assign_vendor(transactions(spark, d), dictionary, fuzzy=False).withColumn("direction", vd.direction_of("amount"))
    return matched.groupBy("vendor", "direction").agg(cents(F.sum("amount")).alias("cents"), F.count("*").alias("n"))


RULES_SQL = "SELECT p_name AS phrase, 'R' || p_name AS vendor, row_number() OVER (ORDER BY p_name) AS rule_no FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT w, 'W' || w, 1000 + row_number() OVER (ORDER BY w) FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM part)"


def rule_rows(spark, d) -> DataFrame:
    from ledgerloom.plans.ordered import number_rows

    names = table(spark, d, "part").select("p_name").distinct()
    first = names.select(F.element_at(F.split("p_name", " "), 1).alias("w")).distinct()
    # Rule numbers only break ties between equal phrases, so any stable order serves.
    a = number_rows(names.withColumn("g", F.lit(0)), ["g"], ["p_name"], [F.substring("p_name", 1, 3)], "rule_no")
    b = number_rows(first.withColumn("g", F.lit(0)), ["g"], ["w"], [F.substring("w", 1, 3)], "rule_no")
    rows = a.select(F.col("p_name").alias("phrase"), F.concat(F.lit("R"), "p_name").alias("vendor"), "rule_no")
    return rows.unionByName(b.select(F.col("w").alias("phrase"), F.concat(F.lit("W"), "w").alias("vendor"), (F.col("rule_no") + 1000).alias("rule_no")))


@query(
    "rule_longest_match",
    f"""WITH r AS ({RULES_SQL}), t AS (SELECT DISTINCT description FROM ({TX_SQL})),
    b AS (SELECT description, arg_min(vendor, (-length(phrase), rule_no)) AS rule_vendor FROM t JOIN r ON contains(description, upper(phrase)) GROUP BY description)
    SELECT l_orderkey, l_linenumber, rule_vendor FROM ({TX_SQL}) LEFT JOIN b USING (description)""",
)
def rule_longest_match(spark, d):
    out = vd.match_rules(transactions(spark, d), rule_rows(spark, d))
    return out.select("l_orderkey", "l_linenumber", "rule_vendor")


@query(
    "vendor_precedence",
    f"""WITH t AS (SELECT *, {norm_sql('description')} AS n, CASE WHEN l_orderkey % 10 = 0 THEN 'Payee ' || l_linenumber ELSE '' END AS payee FROM ({TX_SQL})),
    p AS ({RULES_SQL}), r AS (SELECT description, co, arg_min(p.vendor, (-length(phrase), rule_no)) AS rv FROM (SELECT DISTINCT description, l_linenumber % 3 AS co FROM t) JOIN p ON rule_no % 3 = co AND contains(description, upper(phrase)) GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, coalesce(nullif(payee, ''), rv, vendor, '') AS vendor FROM t LEFT JOIN r ON r.description = t.description AND co = l_linenumber % 3 LEFT JOIN ({CONTAINS_SQL}) ON n = norm_text""",
)
def vendor_precedence(spark, d):
    payee = F.when(F.col("l_orderkey") % 10 == 0, F.concat(F.lit(" Payee "), F.col("l_linenumber").cast("string"))).otherwise("")
    # three companies, each with its own rules; what they miss goes on to the dictionary
    tx = transactions(spark, d).withColumns({"payee": payee, "company": F.col("l_linenumber") % 3})
    rules = rule_rows(spark, d).withColumn("company", (F.col("rule_no") % 3).cast("int"))
    out = vd.assign_vendor(tx, vd.build_vendor_dict(vendor_sheet(spark, d), "row_no"), rules, keys=["company"], fuzzy=False)
    return out.select("l_orderkey", "l_linenumber", "vendor")


@query("vendor_fuzzy")
def vendor_fuzzy(spark, d):
    """Edited part names against the dictionary; tested against brute force on a fixture."""
    p = table(spark, d, "part")
    edited = F.concat(F.upper(F.substring("p_name", 1, 3)), F.lit("X"), F.upper(F.expr("substring(p_name, 4)")), F.lit(" "), F.upper(F.right("p_brand", F.lit(2))))
    texts = p.select(edited.alias("norm_text")).distinct()
    return vd.match_vendor_fuzzy(texts, vd.build_vendor_dict(vendor_sheet(spark, d), "row_no"))


@query(
    "account_lookup",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'V' || (l_orderkey % 7) END AS vendor, CASE WHEN c < 0 THEN 'debits' ELSE 'credits' END AS direction, c, tx_date FROM ({TX_SQL}))
    SELECT strftime(tx_date, '%m/%d/%Y') AS "Date", vendor AS "Vendor", CASE WHEN vendor = '' OR CAST(right(vendor, 1) AS INT) % 2 = 0 THEN '' ELSE 'Acct ' || vendor || ' ' || direction END AS "Account", '' AS "Memo", abs(c) AS cents, l_orderkey, direction FROM t""",
)
def account_lookup(spark, d):
    tx = transactions(spark, d).withColumn("vendor", F.when(F.col("l_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("V"), (F.col("l_orderkey") % 7).cast("string"))))
    named = table(spark, d, "nation").select(F.concat(F.lit("V"), (F.col("n_nationkey") % 7).cast("string")).alias("vendor")).distinct()
    odd = named.filter(F.right("vendor", F.lit(1)).cast("int") % 2 == 1)
    accounts = odd.select("vendor", F.explode(F.array(F.lit("debits"), F.lit("credits"))).alias("direction"))
    accounts = accounts.withColumn("account", F.concat_ws(" ", F.lit("Acct"), "vendor", "direction"))
    out = vd.assign_account(tx, accounts).withColumn("check_number", F.col("l_orderkey").cast("string"))
    sides = [vd.shape_output(out.filter(F.col("direction") == x), x).withColumn("direction", F.lit(x)) for x in ("debits", "credits")]
    both = sides[0].unionByName(sides[1])
    return both.select("Date", "Vendor", "Account", "Memo", cents("Amount").alias("cents"), F.col("Check Number").cast("bigint").alias("l_orderkey"), "direction")


@query(
    "last_month",
    "SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_date, CAST(month(max(o_orderdate)) AS BIGINT) AS month, CAST(year(max(o_orderdate)) AS BIGINT) AS year FROM orders GROUP BY o_custkey",
)
def last_month(spark, d):
    tx = orders(spark, d).select("o_custkey", F.col("day").alias("tx_date"))
    out = vd.last_transaction_month(tx, ["o_custkey"])
    return out.select("o_custkey", "last_date", F.col("month").cast("bigint").alias("month"), F.col("year").cast("bigint").alias("year"))


@query(
    "card_match",
    """WITH o AS (SELECT o_orderkey, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS last4, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders),
    c AS (SELECT o_orderkey, last4, day, CASE WHEN o_orderkey % 2 = 0 THEN p ELSE -p END AS p, CASE o_orderkey % 3 WHEN 0 THEN 'Office Expense:Meal' ELSE 'Travel Expense:Meals ' END AS cls FROM o WHERE o_orderkey % 3 <> 2 AND o_orderkey % 5 <> 0),
    s AS (SELECT last4, day, p, arg_min(cls, o_orderkey) AS cls FROM c GROUP BY ALL), a AS (SELECT last4, day, abs(p) AS p, arg_min(cls, o_orderkey) AS cls FROM c GROUP BY ALL)
    SELECT o.o_orderkey, coalesce(s.cls, a.cls, '') AS classification FROM o LEFT JOIN s USING (last4, day, p) LEFT JOIN a USING (last4, day, p)""",
)
def card_match(spark, d):
    o = orders(spark, d).select("o_orderkey", F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("last4"), F.col("day").alias("tx_date"), F.col("price").alias("amount"))
    k = F.col("o_orderkey")
    card = o.withColumn("amount", F.when(k % 2 == 0, F.col("amount")).otherwise(-F.col("amount"))).withColumns(
        {"category": F.when(k % 5 == 0, "Hotel").otherwise("Food & stay"), "type": F.when(k % 3 == 0, "Staff meal").when(k % 3 == 1, "Business trip").otherwise("Other")}
    )
    classed = cards.classify_expense(card, ["category"], "type")
    return cards.match_card_keys(o, classed, ["o_orderkey"]).select("o_orderkey", "classification")


@query(
    "payee_standard",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE 'zq' || p_partkey || ' vv' END AS payee_std, CASE p_partkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 96 ELSE 0 END AS payee_score FROM part WHERE p_retailprice >= 1000""",
)
def payee_standard(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    payee = F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit(" Memo"))).when(k % 3 == 1, F.concat("p_name", F.lit(" #"), k.cast("string"))).otherwise(F.concat(F.lit("zq"), k.cast("string"), F.lit(" vv")))
    checks = p.select("p_partkey", payee.alias("payee"), F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("amount"))
    sheet = p.select(F.col("p_name").alias("Vendor Name"), F.col("p_type").alias("Note"))
    out = vd.standardize_payee(vd.filter_min_amount(checks), vd.build_payee_dict(sheet))
    return out.select("p_partkey", "payee_std", "payee_score")


@query("payee_token_set")
def payee_token_set(spark, d):
    """Payees with reordered and extra words; the scorer is checked by brute force in the tests."""
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    payee = F.concat_ws(" ", F.lit("the"), words[1], words[0])
    return vd.standardize_payee(p.select("p_partkey", payee.alias("payee")), p.select(F.col("p_name").alias("payee_norm")))


@query(
    "vendor_list_pick",
    """SELECT c_name AS company, CASE c_custkey % 3 WHEN 0 THEN '/v/' || c_name || '.csv' WHEN 1 THEN '/v/zz ' || lower(replace(c_name, '#', ' ')) || ' list.xlsx' END AS path FROM customer WHERE c_custkey % 3 <> 2""",
)
def vendor_list_pick(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    file = F.when(k % 3 == 0, F.concat("c_name", F.lit(".csv"))).when(k % 3 == 1, F.concat(F.lit("zz "), F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))), F.lit(" list.xlsx"))).otherwise(F.concat("c_name", F.lit(".docx")))
    return vd.pick_vendor_list(c.select(F.col("c_name").alias("company")), c.select(F.concat(F.lit("/v/"), file).alias("path")))


@query(
    "column_roles",
    """SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 AS BIGINT) AS cents FROM lineitem GROUP BY l_orderkey""",
)
def column_roles(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("Order Memo"), money("l_extendedprice").alias("Charge Amount (USD)"))  # noqa: E741
    key, amount = columns.resolve_description_col(l), columns.resolve_col(l, ["Debit", "ChargeAmount"])
    assert amount == columns.resolve_amount_col(l)
    return l.groupBy(F.col(key).alias("l_orderkey")).agg(cents(F.sum(F.col(amount))).alias("cents"))
