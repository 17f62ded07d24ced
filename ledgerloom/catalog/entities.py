"""Client identity, relation graph and merge queries over customers and supplier-part edges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog.registry import orders, query, table
from ledgerloom.operators import entities as en
from ledgerloom.operators import graph as gr
from ledgerloom.operators import merges as mg

C_SQL = """c AS (SELECT c_custkey AS client_idx, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'DBA ' || c_custkey ELSE '' END AS dba, c_mktsegment = 'HOUSEHOLD' AS ind,
  lpad(CAST(c_custkey % 700 AS VARCHAR), 9, '0') AS num, CASE WHEN c_custkey % 4 = 0 THEN 'id' || c_custkey ELSE '' END AS id, 'Mgr ' || (c_nationkey % 5) AS acct_mgr, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def clients(spark, d) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    num = F.lpad((k % 700).cast("string"), 9, "0")
    ind = F.col("c_mktsegment") == "HOUSEHOLD"
    return c.select(
        k.alias("client_idx"), F.col("c_name").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("DBA "), k.cast("string"))).otherwise("").alias("dba"),
        F.when(ind, "Individual").otherwise("LLC").alias("entity_type"), F.when(ind, "").otherwise(num).alias("ein"), F.when(ind, num).otherwise("").alias("ssn"),
        F.when(k % 4 == 0, F.concat(F.lit("id"), k.cast("string"))).otherwise("").alias("id"),
        F.concat(F.lit("Mgr "), (F.col("c_nationkey") % 5).cast("string")).alias("acct_mgr"), F.col("n_name").alias("city"),
    )


@query(
    "search_clients",
    f"""WITH {C_SQL} SELECT client_idx, 'text' AS how FROM c WHERE contains(lower(n_name), 'nation_1') OR contains(lower(n_name), 'nation_1')
    UNION ALL SELECT client_idx, 'digits' FROM c WHERE (NOT ind AND right(num, 9) LIKE '%0123') OR contains(name, '0123') OR contains(dba, '0123')
    UNION ALL SELECT client_idx, 'manager' FROM c WHERE acct_mgr IN ('Mgr 1', 'Mgr 3')""",
)
def search_clients(spark, d):
    c = clients(spark, d)
    # The nation word "nation_1" tokenizes to "nation" and "1"; both must occur.
    c2 = c.withColumn("city", F.replace("city", F.lit("_"), F.lit("-")))
    text = en.search_clients(c2.select("client_idx", F.lit("").alias("name"), "city"), "NATION-1")
    digits = en.search_clients(c.select("client_idx", "name", "dba", "ein"), "0123")
    managed = en.search_clients(c, "", ["mgr 1", "MGR 3"])
    tag = lambda df, how: df.select("client_idx", F.lit(how).alias("how"))
    return tag(text, "text").unionByName(tag(digits, "digits")).unionByName(tag(managed, "manager"))


@query(
    "suggest_clients",
    f"WITH {C_SQL} SELECT client_idx, name || ' — ' || CASE WHEN dba = '' THEN 'No DBA' ELSE dba END || ' — ' || CASE WHEN ind THEN 'No EIN' ELSE num END AS label FROM c WHERE contains(lower(name), '00000') ORDER BY client_idx LIMIT 20",
)
def suggest_clients(spark, d):
    return en.suggest(clients(spark, d), "00000")


@query(
    "company_labels",
    f"WITH {C_SQL} SELECT CASE WHEN dba <> '' THEN dba || ' — ' || name ELSE name END AS label, CASE WHEN ind THEN name ELSE num END AS key FROM c",
)
def company_labels(spark, d):
    return en.sort_mixed(en.company_labels(clients(spark, d)), "key")


@query("rate_refresh", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 OR CAST(o_orderdate AS DATE) < DATE '1998-04-01'")
def rate_refresh(spark, d):
    k = F.col("o_orderkey") % 4
    o = orders(spark, d).withColumn("tax_rates_last_checked", F.when(k == 0, "").when(k == 1, "soon").otherwise(F.col("day").cast("string")))
    return en.needs_rate_refresh(o, dt.date(1998, 6, 17)).select("o_orderkey")


@query(
    "resolve_keys",
    f"""WITH {C_SQL}, e AS (SELECT num, min(client_idx) AS i FROM c WHERE NOT ind GROUP BY num), s AS (SELECT num, min(client_idx) AS i FROM c GROUP BY num)
    SELECT c.client_idx, CASE client_idx % 4 WHEN 0 THEN client_idx WHEN 1 THEN e.i WHEN 2 THEN s.i END AS found FROM c LEFT JOIN e USING (num) LEFT JOIN s USING (num)""",
)
def resolve_keys(spark, d):
    c = clients(spark, d)
    k = F.col("client_idx") % 4
    num = F.coalesce(F.nullif("ein", F.lit("")), "ssn")
    raw = F.when(F.col("client_idx") % 8 == 0, F.concat(F.lit("client:"), "id")).otherwise(F.col("id"))
    key = F.when(k == 0, raw).when(k == 1, F.concat(F.lit("EIN: "), num)).when(k == 2, F.concat(F.lit("ssn:"), num)).otherwise("nobody")
    return en.resolve_client(c.select("client_idx", key.alias("key")).withColumnRenamed("client_idx", "row"), "key", c, "found").select(F.col("row").alias("client_idx"), "found")


@query(
    "duplicate_ids",
    f"WITH {C_SQL} SELECT client_idx, CASE WHEN ind THEN 'SSN' ELSE 'EIN' END AS kind, num AS digits, n FROM (SELECT *, count(*) OVER (PARTITION BY ind, num) AS n FROM c) WHERE n > 1",
)
def duplicate_ids(spark, d):
    return en.duplicate_identity(clients(spark, d)).select("client_idx", "kind", "digits", "n")


@query(
    "link_candidates",
    f"""WITH {C_SQL} SELECT CASE WHEN ind THEN 'ssn:' ELSE 'ein:' END || num AS id, min(client_idx) AS client_idx, NOT ind AS is_company FROM c GROUP BY name, ind, num""",
)
def link_candidates(spark, d):
    return en.link_candidates(clients(spark, d), exclude="ein:none").select("id", "client_idx", "is_company")


@query(
    "managers",
    f"""WITH {C_SQL}, m AS (SELECT lower(acct_mgr) AS n, arg_min(acct_mgr, client_idx) AS name FROM c GROUP BY 1)
    SELECT 'am_' || substr(sha1(n || '||'), 1, 12) AS id, upper(name) AS name, (SELECT count(*) FROM c WHERE lower(acct_mgr) = n) AS n_companies FROM m""",
)
def managers(spark, d):
    c = clients(spark, d)
    shout = c.select(F.col("client_idx").alias("pos"), F.upper("acct_mgr").alias("name"), F.lit("").alias("email"), F.lit("").alias("phone"))
    quiet = shout.withColumn("pos", F.col("pos") + 1000000).withColumn("name", F.initcap("name"))
    m = en.dedupe_managers(shout.unionByName(quiet)).join(en.manager_names(shout), "name")
    counts = c.groupBy(F.upper("acct_mgr").alias("name")).agg(F.count("*").alias("n_companies"))
    return m.join(counts, "name").select("id", "name", "n_companies")


@query(
    "merge_managers",
    """WITH cur AS (SELECT DISTINCT 'mgr ' || s_suppkey || '|m' || s_suppkey % 4 || '@x.com|' AS k FROM supplier),
    inc AS (SELECT c_custkey AS pos, c_custkey // 3 AS n, CASE WHEN c_custkey % 2 = 0 THEN 'MGR  ' ELSE 'Mgr ' END || c_custkey // 3 AS name, CASE WHEN c_custkey % 5 = 0 THEN 'given' || c_custkey END AS given FROM customer),
    k AS (SELECT *, 'mgr ' || n || '|m' || n % 4 || '@x.com|' AS k FROM inc)
    SELECT pos, name, coalesce(given, 'am_' || substr(sha1(k), 1, 12)) AS id FROM k WHERE k NOT IN (SELECT k FROM cur) QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1""",
)
def merge_managers(spark, d):
    """Suppliers are the managers on file, customers come in by threes that differ in letter case and blanks."""
    mail = lambda n, tail: F.concat(F.lit("m"), (n % 4).cast("string"), F.lit(tail))
    k, n = F.col("s_suppkey"), F.floor(F.col("c_custkey") / 3)
    now = table(spark, d, "supplier").select(F.concat(F.lit("Mgr "), k.cast("string")).alias("name"), mail(k, "@x.com").alias("email"), F.lit("").alias("phone"))
    c = table(spark, d, "customer")
    shout = F.when(F.col("c_custkey") % 2 == 0, "MGR  ").otherwise("Mgr ")
    new = c.select(
        F.col("c_custkey").alias("pos"), F.concat(shout, n.cast("string")).alias("name"), mail(n, "@X.com").alias("email"), F.lit(None).cast("string").alias("phone"),
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("given"), F.col("c_custkey").cast("string"))).alias("id"),
    )
    return mg.merge_managers(now, new).select("pos", "name", "id")


@query(
    "merge_client_update",
    """WITH k AS (SELECT c_custkey AS k FROM customer), m AS (SELECT k, CASE WHEN k % 3 <> 0 THEN 'M' || k END AS name, 'c' || (k + 1) AS link FROM k)
    SELECT 'c' || k AS id, CASE WHEN k % 2 = 0 THEN coalesce(name, 'N' || k) ELSE 'N' || k END AS name, 'Town' AS city, CASE WHEN k % 2 = 0 THEN link ELSE '' END AS links,
      CASE k % 4 WHEN 0 THEN 'Old,New' || k WHEN 1 THEN 'Old' WHEN 2 THEN 'New' || k ELSE '' END AS people FROM m
    UNION ALL SELECT 'z' || k, name, NULL, link, 'New' || k FROM m WHERE k % 10 = 5""",
)
def merge_client_update(spark, d):
    """Even customers get an update, some rows are new; each update brings a person and a business that may be linked already."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    text = lambda prefix, x=k: F.concat(F.lit(prefix), x.cast("string"))
    person = lambda role, link, name: F.struct(F.lit("").alias("id"), role.alias("role"), link.alias("linked_client_id"), name.alias("name"), F.lit("").alias("email"), F.lit("").alias("phone"))
    business, old, new = person(F.lit("business"), text("c", k + 1), F.lit("")), person(F.lit("officer"), F.lit(""), F.lit("Old")), person(F.lit("officer"), F.lit(""), text("New"))
    some = lambda test, x: F.filter(F.array(x), lambda _: test)
    now = c.select(
        text("c").alias("id"), text("N").alias("name"), F.lit("Town").alias("city"), some(k % 4 == 0, business).alias("relations"), some((k % 4).isin(0, 1), old).alias("officers")
    )
    update = c.filter((k % 2 == 0) | (k % 10 == 5)).select(
        F.concat(F.when(k % 2 == 0, "c").otherwise("z"), k.cast("string")).alias("id"),
        F.when(k % 3 != 0, text("M")).alias("name"), F.array(business, new).alias("officers"),
    )
    out = mg.merge_client_update(now, update)
    return out.select("id", "name", "city", F.array_join("relations.linked_client_id", ",").alias("links"), F.array_join("officers.name", ",").alias("people"))


@query("manager_companies", f"WITH {C_SQL} SELECT client_idx FROM c WHERE acct_mgr = 'Mgr 2'")
def manager_companies(spark, d):
    return en.companies_of_manager(clients(spark, d), " mgr 2 ").select("client_idx")


@query(
    "task_owner",
    f"""WITH {C_SQL}, nm AS (SELECT lower(name) AS n, max(client_idx) AS i FROM c GROUP BY 1), nu AS (SELECT num, max(client_idx) FILTER (WHERE NOT ind) AS e, max(client_idx) FILTER (WHERE ind) AS s FROM c GROUP BY num),
    o AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN (SELECT i FROM nm WHERE n = lower(c.name)) WHEN 2 THEN coalesce(e, s) END AS own FROM orders JOIN c ON o_custkey = c.client_idx JOIN nu USING (num))
    SELECT o_orderkey, CASE WHEN own IS NULL THEN 'nobody' ELSE k.num END AS client_id, CASE WHEN own IS NULL THEN 'not_found' WHEN o_orderkey % 4 = 2 THEN 'unchanged' ELSE 'updated' END AS outcome FROM o LEFT JOIN c k ON own = k.client_idx""",
)
def task_owner(spark, d):
    c = clients(spark, d)
    o = table(spark, d, "orders").join(c.select(F.col("client_idx").alias("o_custkey"), "name", F.coalesce(F.nullif("ein", F.lit("")), "ssn").alias("num")), "o_custkey")
    k = F.col("o_orderkey") % 4
    tasks = o.select(
        "o_orderkey", F.when(k == 0, F.col("o_custkey")).alias("client_idx"), F.when(k == 1, F.upper("name")).otherwise("").alias("client_name"),
        F.when(k == 2, F.col("num")).when(k == 3, "nobody").otherwise("").alias("client_id"),
    )
    return en.resolve_task_owner(tasks, c).select("o_orderkey", "client_id", "outcome")


@query(
    "client_tasks",
    f"""WITH {C_SQL}, t AS (SELECT o_orderkey, o_custkey, c.name, c.num, c.ind FROM orders JOIN c ON o_custkey = client_idx)
    SELECT o_custkey AS client_idx, o_orderkey AS task_id FROM t WHERE o_orderkey % 3 = 0
    UNION SELECT c.client_idx, o_orderkey FROM t JOIN c ON t.name = c.name WHERE o_orderkey % 3 = 1
    UNION SELECT c.client_idx, o_orderkey FROM t JOIN c ON t.num = c.num WHERE o_orderkey % 3 = 2 AND NOT t.ind AND NOT c.ind""",
)
def client_tasks(spark, d):
    c = clients(spark, d)
    o = table(spark, d, "orders").join(c.select(F.col("client_idx").alias("o_custkey"), "name", F.col("ein").alias("num")), "o_custkey")
    k = F.col("o_orderkey") % 3
    tasks = o.select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, F.col("o_custkey")).alias("client_idx"), F.when(k == 1, F.upper("name")).otherwise("").alias("client_name"),
        F.lit("").alias("client_id"), F.when(k == 2, F.col("num")).otherwise("").alias("ein"),
    )
    return en.tasks_for_clients(tasks, c.withColumn("id", F.lit("")))


@query(
    "contacts",
    """SELECT o_custkey AS client_idx, string_agg(DISTINCT 'u' || (o_orderkey % 4) || '@x.io', ',' ORDER BY 'u' || (o_orderkey % 4) || '@x.io') AS emails, count(DISTINCT o_orderkey % 3) AS phones FROM orders GROUP BY 1""",
)
def contacts(spark, d):
    o = table(spark, d, "orders")
    mail = F.concat(F.lit(" u"), (F.col("o_orderkey") % 4).cast("string"), F.lit("@x.io; "), F.lit(""))
    people = o.groupBy(F.col("o_custkey").alias("client_idx")).agg(
        F.collect_set(F.struct(mail.alias("email"), F.concat(F.lit("555-"), (F.col("o_orderkey") % 3).cast("string")).alias("phone"))).alias("relations")
    )
    flat = en.flat_contacts(people)
    return flat.select("client_idx", F.array_join(F.array_sort("emails"), ",").alias("emails"), F.size("phones").cast("bigint").alias("phones"))


@query(
    "find_person",
    """SELECT a.o_orderkey AS a_pos, min(b.o_orderkey) AS b_pos FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey % 2 = 1 AND
      (a.o_orderkey % 50 = b.o_orderkey % 50 OR a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus) WHERE a.o_orderkey % 2 = 0 GROUP BY 1""",
)
def find_person(spark, d):
    o = table(spark, d, "orders")
    p = o.select(
        F.col("o_custkey").alias("client_idx"), F.lit(0).alias("list_rank"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("first_name"),
        F.col("o_orderstatus").alias("last_name"), F.concat((F.col("o_orderkey") % 50 + 10).cast("string"), F.lit("@X")).alias("email"), F.lit("").alias("phone"),
    )
    out = en.find_person(p.filter("pos % 2 = 0"), p.filter("pos % 2 = 1"))
    return out.select("a_pos", "b_pos")


# Edges: suppliers link to parts' suppliers; one in five edges lacks its reverse on purpose.
EDGE_SQL = """e AS (SELECT src, dst, min(l_orderkey) AS pos FROM (SELECT l_suppkey AS src, l_partkey % (SELECT count(*) + 5 FROM supplier) AS dst, l_orderkey FROM lineitem) GROUP BY ALL),
  g AS (SELECT src, pos, CASE WHEN dst < (SELECT count(*) FROM supplier) THEN dst END AS dst, dst AS raw, CASE WHEN dst % 3 = 0 THEN 'parent' WHEN dst % 3 = 1 THEN 'owner' ELSE 'spouse' END AS role FROM e WHERE (src + raw_mod(src, dst)) % 5 <> 0)""".replace("raw_mod(src, dst)", "2 * dst")


def supplier_nodes(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("client_idx"), F.col("s_name").alias("name"), F.when(k % 2 == 0, "individual").otherwise("LLC").alias("entity_type"),
        F.lpad((k + 1).cast("string"), 9, "0").alias("ein"), F.lit("").alias("ssn"), F.lit("").alias("id"), F.concat(F.lit("c"), k.cast("string")).alias("city"),
    )


def edges(spark, d) -> DataFrame:
    """Edges as they come out of explode_edges: the id resolved against the supplier book."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    total = n.first()["n"]
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % (total + 5)).alias("raw"), "l_orderkey")  # noqa: E741
    e = l.groupBy("src", "raw").agg(F.min("l_orderkey").alias("pos")).filter((F.col("src") + 2 * F.col("raw")) % 5 != 0)
    r = F.col("raw") % 3
    key = F.concat(F.when(F.col("raw") % 2 == 0, "ssn:").otherwise("ein:"), F.lpad((F.col("raw") + 1).cast("string"), 9, "0"))
    rows = e.select(
        "src", "pos", key.alias("id"), F.when(r == 0, "parent").when(r == 1, "owner").otherwise("spouse").alias("role"), "raw",
        *[F.lit("" if c != "city" else "old").alias(c) for c in gr.ATTRIBUTES],
    )
    return en.resolve_client(rows, "id", supplier_nodes(spark, d), "dst")


@query("graph_edges", f"WITH {EDGE_SQL} SELECT src, pos, raw, dst, role FROM g")
def graph_edges(spark, d):
    return edges(spark, d).select("src", "pos", "raw", "dst", "role")


@query(
    "back_links",
    f"""WITH {EDGE_SQL}, k AS (SELECT * FROM g WHERE dst IS NOT NULL AND dst <> src), m AS (SELECT src, dst, arg_min(role, pos) AS role FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.src = a.dst AND b.dst = a.src) GROUP BY ALL)
    SELECT src, dst, role, 'c' || dst AS city FROM (SELECT dst AS src, src AS dst, CASE role WHEN 'parent' THEN 'child' WHEN 'owner' THEN 'business' ELSE role END AS role FROM m)""",
)
def back_links(spark, d):
    e = edges(spark, d)
    grown = gr.add_missing_back_links(e, supplier_nodes(spark, d))
    return grown.filter(F.col("city") != "old").select("src", "dst", "role", "city")


@query(
    "one_way_links",
    f"WITH {EDGE_SQL} SELECT src, raw, role FROM g a WHERE dst IS NULL OR dst = src OR src % 9 = 5 OR EXISTS (SELECT 1 FROM g b WHERE b.src = a.dst AND b.dst = a.src)",
)
def one_way_links(spark, d):
    """Every ninth client has no key of its own, so nothing can link back to it."""
    nodes = supplier_nodes(spark, d)
    nodes = nodes.withColumn("ein", F.when(F.col("client_idx") % 9 == 5, "").otherwise(F.col("ein")))
    return gr.drop_one_way_links(edges(spark, d), nodes).select("src", "raw", "role")


@query(
    "link_unlink",
    f"""WITH {EDGE_SQL}, p AS (SELECT s_suppkey AS a, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS b FROM supplier WHERE s_suppkey % 3 = 0),
    r AS (SELECT a AS src, b AS dst, CASE WHEN a % 2 = 0 THEN 'business' ELSE 'employee' END AS role FROM p UNION ALL SELECT b, a, CASE WHEN a % 2 = 0 THEN 'owner' ELSE 'business' END FROM p),
    u AS (SELECT src, dst, coalesce(r.role, g.role) AS role FROM g FULL OUTER JOIN r USING (src, dst) WHERE dst IS NOT NULL)
    SELECT src, dst, role FROM u WHERE NOT (src % 10 = 4 AND dst = src - 1 OR dst % 10 = 4 AND src = dst - 1)""",
)
def link_unlink(spark, d):
    nodes = supplier_nodes(spark, d)
    total = nodes.count()
    pairs = nodes.filter(F.col("client_idx") % 3 == 0).select(F.col("client_idx").alias("a"), ((F.col("client_idx") + 1) % total).alias("b"), F.lit("employee").alias("role"))
    linked = gr.link(edges(spark, d).drop("raw"), nodes, pairs)
    gone = nodes.filter(F.col("client_idx") % 10 == 4).select(F.col("client_idx").alias("a"), (F.col("client_idx") - 1).alias("b"))
    return gr.unlink(linked, gone).filter(F.col("dst").isNotNull()).select("src", "dst", "role")


@query("cleanup_links", f"WITH {EDGE_SQL} SELECT src, raw FROM g WHERE src % 7 <> 3 AND (dst IS NULL OR dst % 7 <> 3)")
def cleanup_links(spark, d):
    gone = supplier_nodes(spark, d).filter(F.col("client_idx") % 7 == 3)
    return gr.drop_links_to(edges(spark, d), gone).select("src", "raw")


@query("refresh_attrs", f"WITH {EDGE_SQL} SELECT src, raw, coalesce('c' || dst, 'old') AS city FROM g")
def refresh_attrs(spark, d):
    return gr.refresh_link_attributes(edges(spark, d), supplier_nodes(spark, d)).select("src", "raw", "city")


@query(
    "canonical_links",
    f"WITH {EDGE_SQL} SELECT count(*) AS scanned, count(dst) AS updated, count(DISTINCT CASE WHEN dst IS NOT NULL THEN src END) AS touched, count(*) - count(dst) AS unresolved FROM g",
)
def canonical_links(spark, d):
    # Legacy spelling: the prefix is upper case, so every resolvable id needs rewriting.
    old = edges(spark, d).withColumn("id", F.concat(F.upper(F.substring("id", 1, 4)), F.substr("id", F.lit(5))))
    _, stats = gr.canonicalize_links(old, supplier_nodes(spark, d))
    return stats


@query(
    "relation_view",
    f"WITH {EDGE_SQL} SELECT src, raw, CASE WHEN dst IS NULL THEN '' ELSE s_name END AS entity_name, upper(role[1]) || substr(role, 2) AS role_text FROM g LEFT JOIN supplier ON s_suppkey = dst",
)
def relation_view(spark, d):
    return gr.relation_view(edges(spark, d), supplier_nodes(spark, d)).select("src", "raw", "entity_name", "role_text")


@query(
    "merge_clients",
    """WITH RECURSIVE k AS (SELECT c_custkey AS r, c_custkey // 16 AS g, c_custkey % 16 AS i, c_custkey // 4 AS a, c_custkey // 16 * 8 + c_custkey * 5 % 8 AS b, c_custkey % 10 = 0 AS old FROM customer),
    s AS (SELECT g, CAST(-1 AS BIGINT) AS i, coalesce(list(a) FILTER (WHERE old), []) AS ta, coalesce(list(b) FILTER (WHERE old), []) AS tb, CAST(NULL AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS outcome FROM k GROUP BY g
      UNION ALL SELECT s.g, s.i + 1, CASE WHEN list_contains(ta, a) OR list_contains(tb, b) OR x.r IS NULL THEN ta ELSE list_append(ta, a) END, CASE WHEN list_contains(ta, a) OR list_contains(tb, b) OR x.r IS NULL THEN tb ELSE list_append(tb, b) END,
        x.r, CASE WHEN list_contains(ta, a) OR list_contains(tb, b) THEN 'skipped' ELSE 'added' END FROM s LEFT JOIN k x ON x.g = s.g AND x.i = s.i + 1 AND NOT x.old WHERE s.i < 15)
    SELECT r, outcome FROM s WHERE r IS NOT NULL""",
)
def merge_clients(spark, d):
    """Every tenth customer is the current book; the others come in order, and ids and EINs collide within sixteens."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    ein = F.floor(k / 16) * 8 + k * 5 % 8
    keyed = c.select(k.alias("r"), F.concat(F.lit("i"), F.floor(k / 4).cast("string")).alias("id"), F.lpad((ein + 1).cast("string"), 9, "0").alias("ein"), F.lit("LLC").alias("entity_type"))
    return mg.merge_clients(keyed.filter(F.col("r") % 10 == 0), keyed.filter(F.col("r") % 10 != 0), row="r").select("r", "outcome")


@query(
    "merge_relations",
    """WITH a AS (SELECT o_custkey AS c, o_orderkey % 6 AS id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 GROUP BY ALL), b AS (SELECT o_custkey AS c, o_orderkey % 5 AS id, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 GROUP BY ALL)
    SELECT c AS client_idx, CAST(id AS VARCHAR) AS id, CASE WHEN b.k % 3 > 0 THEN 'm' || b.k WHEN a.k IS NOT NULL THEN 'm' || a.k ELSE '' END AS email, CASE WHEN a.k IS NOT NULL THEN 'n' || a.k ELSE 'n' || b.k END AS nickname, CASE WHEN b.k IS NOT NULL THEN 'r' || b.k ELSE 'r' || a.k END AS role FROM a FULL OUTER JOIN b USING (c, id)""",
)
def merge_relations(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    tag = lambda t: F.concat(F.lit(t), k.cast("string"))

    def side(rows, n, mail):
        return rows.filter(k % n != 0).select(F.col("o_custkey").alias("client_idx"), k.alias("pos"), (k % n).cast("string").alias("id"), tag("r").alias("role"), mail.alias("email"),
                                              tag("n").alias("nickname"), F.lit("").alias("first_name"), F.lit("").alias("last_name"))

    old = side(o.filter(k % 2 == 0), 6, tag("m"))
    new = side(o.filter(k % 2 == 1), 5, F.when(k % 3 > 0, tag("m")).otherwise(""))
    return mg.merge_relations(old, new).select("client_idx", "id", "email", "nickname", "role")


@query(
    "merge_tasks_files",
    """SELECT 'task' AS part, CAST(o_orderkey AS VARCHAR) AS name, o_custkey AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 'keep', p_name, CASE WHEN min(p_partkey) % 2 = 0 THEN 1 ELSE 2 END FROM part GROUP BY p_name
    UNION ALL SELECT 'overwrite', p_name, CASE WHEN min(p_partkey) % 3 = 0 THEN 2 ELSE 1 END FROM part GROUP BY p_name HAVING min(p_partkey) % 2 = 0 OR min(p_partkey) % 3 = 0""",
)
def merge_tasks_files(spark, d):
    o = table(spark, d, "orders")
    c = clients(spark, d)
    t = o.join(c.select(F.col("client_idx").alias("o_custkey"), "name"), "o_custkey").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit(-1).cast("bigint").alias("client_idx"), F.upper("name").alias("client_name"), F.col("o_orderkey").alias("pos")
    )
    tasks = mg.merge_tasks(t.filter(F.col("pos") % 3 == 0), t, c).select(F.lit("task").alias("part"), F.col("id").alias("name"), F.col("client_idx").alias("v"))
    f = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    cur, inc = f.filter("k % 2 = 0").select("name", F.lit(1).cast("bigint").alias("v")), f.select("name", F.lit(2).cast("bigint").alias("v"), "k")
    keep = mg.merge_files(cur, inc.select("name", "v"), "keep").select(F.lit("keep").alias("part"), "name", "v")
    over = mg.merge_files(cur, inc.filter("k % 3 = 0").select("name", "v"), "overwrite").select(F.lit("overwrite").alias("part"), "name", "v")
    return tasks.unionByName(keep).unionByName(over)


@query(
    "deep_fill",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'a,b,c' ELSE 'b,c' END AS tags FROM customer""",
)
def deep_fill(spark, d):
    c = table(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    dst = c.select(F.col("c_custkey").alias("id"), F.when(even, F.col("c_name")).alias("name"), F.when(even, arr("a", "b")).alias("tags"))
    src = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), arr("b", "c").alias("tags"))
    return mg.deep_merge_fill(dst, src, ["id"]).select("id", "name", F.array_join("tags", ",").alias("tags"))


@query(
    "fold_officers",
    """SELECT o_custkey AS client_idx, count(DISTINCT o_orderkey % 8) FILTER (WHERE o_orderkey % 8 <> 0) + max(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE 0 END) AS moved FROM orders GROUP BY 1""",
)
def fold_officers(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey") % 8
    person = F.struct(
        F.lit("").alias("id"), F.concat(F.lit("P"), n.cast("string")).alias("name"), F.lit("").alias("email"), F.lit("").alias("phone"), F.lit("officer").alias("role"),
        F.when(n == 1, "ein:1").otherwise("").alias("linked_client_id"),
    )
    book = o.groupBy(F.col("o_custkey").alias("client_idx")).agg(F.collect_set(person).alias("officers"), F.collect_set(F.when(n == 0, person)).alias("relations"))
    return mg.fold_officers(book).select("client_idx", F.col("officers_moved").cast("bigint").alias("moved"))


@query("merge_counts", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderkey % 3 = 1 THEN 'skipped' ELSE 'updated' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def merge_counts(spark, d):
    k = F.col("o_orderkey") % 3
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("company_id"), F.when(k == 0, "added").when(k == 1, "skipped").otherwise("updated").alias("outcome"))
    return mg.merge_stats(mg.rename_task_keys(o))
