"""Queries that write practice files from the tables, read them back and compare: readers, writers, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.entities import EDGE_SQL, edges, supplier_nodes
from ledgerloom.catalog.practice import hi_wages
from ledgerloom.catalog.registry import ORACLES, cents, cents_sql, orders, query, table
from ledgerloom.operators import checklist as ck
from ledgerloom.operators.graph import apply_reciprocal, edges_to_relations
from ledgerloom.operators.wages import LAYOUTS
from ledgerloom.plans.session import run_folder
from ledgerloom.sources import readers, sinks

#: Rows of one written JSON file.
FILE_ROWS = 1000


def _files(rows: DataFrame, key: Column, item: Column, name: str, whole=lambda items: F.to_json(items)) -> str:
    """Write one JSON file per FILE_ROWS keys; `item` is an element of its list, in key order."""
    path = run_folder(rows.sparkSession, name)
    part = F.lpad(F.floor(key / FILE_ROWS).cast("string"), 12, "0").alias("part")
    lists = rows.groupBy(part).agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), item.alias("v")))), lambda x: x["v"]).alias("items"))
    lists.select("part", whole(F.col("items")).alias("value")).write.partitionBy("part").text(path)
    return path


@query(
    "client_files",
    """WITH p AS (SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS client_idx, c_name AS name,
      CASE WHEN c_custkey % 2 = 1 THEN ['business:'] WHEN c_custkey % 3 = 0 THEN ['officer:Own ' || c_custkey] ELSE [] END AS a, CASE WHEN c_custkey % 5 = 0 THEN ['officer:Off ' || c_custkey] ELSE [] END AS b FROM customer)
    SELECT client_idx, name, array_to_string(list_concat(a, b), '|') AS people, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'LLC' END AS entity_type FROM p""",
)
def client_files(spark, d):
    """Books as JSON lists: legacy owners, officers and relations become one list; positions run over the files."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    link = F.array(F.struct(F.concat(F.lit("ein:"), s).alias("id"), F.lit(" Business ").alias("role")))
    officer = F.array(F.struct(F.concat(F.lit(" Off "), s).alias("name")))
    item = F.struct(
        F.col("c_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("Own "), s)).alias("owner"), F.when(k % 2 == 1, link).alias("relations"),
        F.when(k % 5 == 0, officer).alias("officers"), F.when(k % 7 != 0, "LLC").alias("entity_type"),
    )
    book = readers.read_clients(spark, _files(table(spark, d, "customer"), k, item, "book"))
    people = F.transform("relations", lambda r: F.concat(r["role"], F.lit(":"), r["name"]))
    return book.select("client_idx", "name", F.array_join(people, "|").alias("people"), "entity_type")


@query(
    "task_files",
    """WITH c AS (SELECT c_custkey % 400 AS n, min(c_custkey) AS i FROM customer GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'OTHER' ELSE 'FEDERAL' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE i END AS client_idx,
      CASE WHEN o_orderkey % 5 = 0 THEN 'one-off' ELSE 'monthly' END AS freq, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 28 + 1 END AS dom,
      CAST(o_orderdate AS DATE) AS start_on, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END AS n_completed FROM orders LEFT JOIN c ON n = o_custkey % 500""",
)
def task_files(spark, d):
    """Tasks as JSON lists; a missing position is that of the first client of the name."""
    k = F.col("o_orderkey")
    named = lambda n: F.concat(F.lit("Client "), n.cast("string"))
    day = F.col("day").cast("string")
    item = F.struct(
        k.cast("string").alias("id"), F.when(k % 3 != 0, "federal").alias("kind"), F.when(k % 4 == 0, k).alias("client_idx"), named(F.col("o_custkey") % 500).alias("company_name"),
        F.when(k % 5 != 0, F.struct(F.lit("monthly").alias("freq"), (k % 28 + 1).alias("dom"))).alias("recurrence"), day.alias("start_on"),
        F.when(k % 6 == 0, F.array(F.lit("never"))).otherwise(F.array(day)).alias("completed"),
    )
    clients = table(spark, d, "customer").select(named(F.col("c_custkey") % 400).alias("name"), F.col("c_custkey").alias("client_idx"))
    t = readers.read_tasks(spark, _files(orders(spark, d), k, item, "tasks"), clients)
    return t.select("id", "kind", "client_idx", "freq", F.col("dom").cast("bigint").alias("dom"), "start_on", F.size("completed").alias("n_completed"))


@query(
    "rule_files",
    "SELECT phrase, vendor, rule_no FROM (SELECT p_name || ' ' || p_partkey AS phrase, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS vendor, CAST(row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) - 1 AS INT) AS rule_no FROM part) WHERE vendor <> ''",
)
def rule_files(spark, d):
    """Rules without a vendor are left out, the others keep their place in the file."""
    k = F.col("p_partkey")
    item = F.struct(F.concat("p_name", F.lit(" "), k.cast("string")).alias("phrase"), F.when(k % 4 == 0, " ").otherwise(F.col("p_brand")).alias("vendor"))
    return readers.read_rules(spark, _files(table(spark, d, "part"), k, item, "rules")).select("phrase", "vendor", "rule_no")


@query(
    "account_files",
    """SELECT 'v|' || p_partkey // 2 AS vendor, 'debits' AS direction, coalesce(max('own ' || p_partkey) FILTER (WHERE p_partkey % 2 = 1), max('both ' || p_partkey)) AS account FROM part GROUP BY p_partkey // 2
    UNION ALL SELECT 'v|' || p_partkey // 2, 'credits', 'both ' || p_partkey FROM part WHERE p_partkey % 2 = 0""",
)
def account_files(spark, d):
    """A bare vendor means both directions; a key with its own direction outranks it; the last bar splits."""
    k = F.col("p_partkey")
    own = k % 2 == 1
    name = F.concat(F.lit("v|"), F.floor(k / 2).cast("string"), F.when(own, "|debits").otherwise(""))
    entry = F.struct(name.alias("key"), F.concat(F.when(own, "own ").otherwise("both "), k.cast("string")).alias("value"))
    path = _files(table(spark, d, "part"), k, entry, "accounts", lambda items: F.to_json(F.map_from_entries(items)))
    return readers.read_accounts(spark, path).select("vendor", "direction", "account")


@query("company_files", "SELECT DISTINCT p_brand || ' ' || p_type AS company FROM part")
def company_files(spark, d):
    """Lists and objects with a list, by turns; names are trimmed and distinct over all files."""
    name = F.concat(F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit(" "))
    shape = lambda items: F.when(F.col("part") % 2 == 0, F.to_json(items)).otherwise(F.to_json(F.struct(items.alias("companies"))))
    return readers.read_companies(spark, _files(table(spark, d, "part"), F.col("p_partkey"), name, "companies", shape))


@query(
    "manager_files",
    """WITH m AS (SELECT s_suppkey AS k, 'Mgr ' || s_suppkey % 90 AS name, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'm' || s_suppkey % 45 || '@x' END AS email FROM supplier)
    SELECT DISTINCT 'am_' || substr(sha1(lower(name) || '|' || email || '|'), 1, 12) AS id, name, email FROM m""",
)
def manager_files(spark, d):
    """Names and objects in one list."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Mgr "), (k % 90).cast("string"))
    obj = F.to_json(F.struct(name.alias("name"), F.concat(F.lit("m"), (k % 45).cast("string"), F.lit("@x")).alias("email")))
    text = F.when(k % 2 == 0, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(obj)
    path = _files(table(spark, d, "supplier"), k, text, "managers", lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    return readers.read_managers(spark, path).select("id", "name", "email")


@query(
    "matched_files",
    f"""WITH t AS (SELECT o_orderkey, 'Co ' || o_custkey % 20 AS company, CASE WHEN o_orderkey % 3 = 0 THEN 'credits' ELSE 'debits' END AS direction, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, {cents_sql("o_totalprice")} AS cents FROM orders),
    l AS (SELECT company, max(day) AS last FROM t GROUP BY 1)
    SELECT company, direction, year(last) AS year, month(last) AS month, strftime(day, '%m/%d/%Y') AS "Date", 'V' || k AS "Vendor", cents FROM t JOIN l USING (company)""",
)
def matched_files(spark, d):
    """Import files of both directions, written and read back through their own headers."""
    k = F.col("o_orderkey")
    tx = orders(spark, d).select(
        F.concat(F.lit("Co "), (F.col("o_custkey") % 20).cast("string")).alias("company"), F.when(k % 3 == 0, "credits").otherwise("debits").alias("direction"),
        F.col("day").alias("tx_date"), k.cast("string").alias("check_number"), F.concat(F.lit("V"), k.cast("string")).alias("vendor"), F.lit("a").alias("account"),
        F.when(k % 3 == 0, F.col("price")).otherwise(-F.col("price")).cast("decimal(18,2)").alias("amount"),
    )
    path = run_folder(spark, "matched")
    sinks.write_matched(tx, path)
    sides = [spark.read.option("header", True).csv(f"{path}/direction={x}").withColumn("direction", F.lit(x)) for x in ("debits", "credits")]
    back = sides[0].unionByName(sides[1])
    return back.select("company", "direction", F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "Date", "Vendor", cents("Amount").alias("cents"))


@query(
    "book_commit",
    f"""WITH {EDGE_SQL}, k AS (SELECT * FROM g a WHERE dst IS NULL OR dst = src OR EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src))
    SELECT s_suppkey AS client_idx, s_name AS name, (SELECT count(*) FROM k WHERE src = s_suppkey) AS n_relations, (SELECT string_agg(role, ',' ORDER BY pos, raw % 2 DESC, raw) FROM k WHERE src = s_suppkey) AS roles FROM supplier""",
)
def book_commit(spark, d):
    """Two commits of one book; the second is read back, its one-way links gone; relations of one place are ordered by id."""
    nodes = supplier_nodes(spark, d)
    book = nodes.join(edges_to_relations(edges(spark, d).drop("raw")), "client_idx", "left")
    path = run_folder(spark, "book")
    sinks.write_clients(nodes.withColumn("relations", F.lit(None).cast(book.schema["relations"].dataType)), path)
    sinks.write_clients(book, path)
    roles = F.array_join(F.transform("relations", lambda r: r["role"]), ",")
    return sinks.read_book(spark, path).select("client_idx", "name", F.size("relations").cast("bigint").alias("n_relations"), F.nullif(roles, F.lit("")).alias("roles"))


@query(
    "bundle_round_trip",
    """WITH c AS (SELECT c_custkey AS k, (c_custkey + 1) // 2 AS ein, c_custkey % 5 = 0 AS old, c_name FROM customer),
    added AS (SELECT min(k) AS k FROM c WHERE NOT old AND ein NOT IN (SELECT ein FROM c WHERE old) GROUP BY ein),
    seat AS (SELECT k, (SELECT max(k) FROM c WHERE old) + row_number() OVER (ORDER BY k) AS i FROM added UNION ALL SELECT k, k FROM c WHERE old)
    SELECT 'client' AS part, c_name AS name, i AS v FROM seat JOIN c USING (k)
    UNION ALL SELECT 'task', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE coalesce(i, -1) END FROM orders LEFT JOIN seat ON k = o_custkey
    UNION ALL SELECT 'clients_added', '', count(*) FROM added UNION ALL SELECT 'clients_skipped', '', (SELECT count(*) FROM c WHERE NOT old) - count(*) FROM added
    UNION ALL SELECT 'tasks_added', '', count(*) FROM orders WHERE o_orderkey % 4 <> 0""",
)
def bundle_round_trip(spark, d):
    """Part of the clients and tasks are exported, and imported into the rest; positions follow without gaps."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        k.alias("client_idx"), F.col("c_name").alias("name"), F.lpad((F.floor((k + 1) / 2) + 1).cast("string"), 9, "0").alias("ein"), F.lit("LLC").alias("entity_type")
    )
    o = orders(spark, d).join(c.select(F.col("client_idx").alias("o_custkey"), "name"), "o_custkey").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit(-1).cast("bigint").alias("unseated"), F.col("o_custkey").alias("client_idx"), F.col("name").alias("client_name"), "o_orderkey"
    )
    own = o.filter("o_orderkey % 4 = 0").select("id", "client_idx", "client_name")
    sent = o.filter("o_orderkey % 4 <> 0").select("id", F.col("unseated").alias("client_idx"), "client_name")
    path = run_folder(spark, "bundle")
    sinks.export_bundle({"clients": c.filter("client_idx % 5 <> 0"), "tasks": sent}, path)
    tables, counts = sinks.import_bundle(spark, path, {"clients": c.filter("client_idx % 5 = 0"), "tasks": own})
    rows = tables["clients"].select(F.lit("client").alias("part"), "name", F.col("client_idx").alias("v"))
    tasks = tables["tasks"].select(F.lit("task").alias("part"), F.col("id").alias("name"), F.col("client_idx").alias("v"))
    told = spark.createDataFrame([(n, "", v) for n, v in counts.items()], "part string, name string, v bigint")
    return rows.unionByName(tasks).unionByName(told)


@query(
    "sorted_labels",
    r"""WITH l AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'É' WHEN 1 THEN '# ' ELSE CAST(p_size AS VARCHAR) || '-' END || p_name AS label FROM part),
    s AS (SELECT label, trim(regexp_replace(strip_accents(lower(label)), '[^a-z0-9]+', ' ', 'g')) AS t FROM l)
    SELECT label, row_number() OVER (ORDER BY regexp_matches(t, '^[0-9]'), encode(t), encode(label)) AS position FROM s""",
)
def sorted_labels(spark, d):
    k = F.col("p_partkey") % 3
    head = F.when(k == 0, "É").when(k == 1, "# ").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("-")))
    return ck.label_positions(table(spark, d, "part").select(F.concat(head, "p_name").alias("label")).distinct())


@query(
    "checklist_files",
    """WITH m AS (SELECT o_custkey AS c, year(o_orderdate) AS y, strftime(o_orderdate, '%b') AS col, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT DISTINCT c, y FROM m),
    cols AS (SELECT unnest(['Jan', 'Feb', 'Mar', 'Q1', 'Apr', 'May', 'Jun', 'Q2', 'Jul', 'Aug', 'Sep', 'Q3', 'Oct', 'Nov', 'Dec', 'Q4']) AS col)
    SELECT 'payroll' AS section, y AS year, 'c' || c AS company_key, col, CASE n % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'To do' ELSE '' END AS value FROM k CROSS JOIN cols LEFT JOIN m USING (c, y, col)""",
)
def checklist_files(spark, d):
    """Nested section, year, company and cell maps with decorated and unknown states."""
    o = orders(spark, d).groupBy("o_custkey", F.year("day").cast("string").alias("y"), F.date_format("day", "MMM").alias("col")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n") % 3 == 0, "✅ Done").when(F.col("n") % 3 == 1, "⏳ To do").otherwise("Waiting")
    months = o.groupBy("o_custkey", "y").agg(F.map_from_entries(F.collect_list(F.struct("col", state.alias("v")))).alias("cells"))
    part = F.floor(F.col("o_custkey") / FILE_ROWS).alias("part")
    entry = F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("k"), F.col("cells").alias("v"))
    years = months.groupBy(part, "y").agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))
    body = F.struct(F.map_keys("cells").alias("companies"), F.col("cells"))
    files = years.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("y").alias("k"), body.alias("v")))).alias("years"))
    path = run_folder(spark, "checklists")
    files.select("part", F.to_json(F.struct(F.struct("years").alias("payroll"))).alias("value")).write.partitionBy("part").text(path)
    return readers.read_checklist(spark, path).withColumn("year", F.col("year").cast("bigint"))


@query("wage_files", ORACLES["wage_rows_hi"])
def wage_files(spark, d):
    """The state's file without a header, written and read back by place."""
    path = run_folder(spark, "wages")
    sinks.write_wage_file(hi_wages(spark, d), "HI", path)
    names = LAYOUTS["HI"]
    back = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    return back.select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])


@query(
    "reciprocal_links",
    """SELECT c_custkey AS client_idx, pos, CASE WHEN pos = 1 THEN '' WHEN c_custkey % 2 = 0 THEN 'ein:' || lpad(CAST(c_custkey + 2 AS VARCHAR), 9, '0')
      WHEN c_custkey % 6 = 1 THEN '' ELSE 'ein:' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS linked_client_id FROM customer CROSS JOIN (VALUES (0), (1)) v(pos)""",
)
def reciprocal_links(spark, d):
    """Each even client's first person points at the next client, whose person of the same e-mail gets the key back; every third pair has no such person."""
    k = F.col("c_custkey")
    ein = lambda n: F.lpad(n.cast("string"), 9, "0")
    c = table(spark, d, "customer")
    nodes = c.select(k.alias("client_idx"), F.col("c_name").alias("name"), F.lit("LLC").alias("entity_type"), ein(k + 1).alias("ein"), F.lit("").alias("ssn"), F.lit("").alias("id"))
    mail = F.concat(F.when((k % 6 == 1) | (F.col("pos") == 1), F.concat(F.lit("o"), k.cast("string"))).otherwise("p"), F.floor(k / 2).cast("string"), F.lit("@x"))
    people = c.select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).select(
        k.alias("client_idx"), F.lit(0).alias("list_rank"), "pos", F.lit("").alias("first_name"), F.lit("").alias("last_name"), mail.alias("email"), F.lit("").alias("phone"),
        F.when((k % 2 == 0) & (F.col("pos") == 0), F.concat(F.lit("EIN: "), ein(k + 2))).otherwise("").alias("linked_client_id"),
    )
    out = apply_reciprocal(people, nodes)
    return out.select("client_idx", "pos", F.replace("linked_client_id", F.lit("EIN: "), F.lit("ein:")).alias("linked_client_id"))
