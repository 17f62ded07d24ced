"""Relation edges between clients: explode, link, unlink, and keep both directions consistent.

An edge is one row: src and dst are client positions (dst null when the id is unknown), pos
its place in the source list, plus the copied attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ids import canonical_key, client_uid, inverse_role, link_roles
from ledgerloom.functions.text import blank, present, words
from ledgerloom.operators.entities import _individual, find_person, resolve_client
from ledgerloom.plans.ordered import first_per_key

ATTRIBUTES = (
    "name", "first_name", "middle_name", "last_name", "nickname", "email", "phone",
    "addr1", "addr2", "city", "state", "zip", "dob",
)
# An incoming non-empty value replaces these; other fields only fill blanks.
INCOMING_WINS = ("name", "first_name", "last_name", "email", "phone", "addr1", "addr2", "city", "state", "zip", "dob")


def explode_edges(clients: DataFrame) -> DataFrame:
    """(src, pos, id, role, attributes, dst): one row per relation, dst resolved by any key form."""
    rows = clients.select(F.col("client_idx").alias("src"), F.posexplode("relations").alias("pos", "r")).select("src", "pos", "r.*")
    rows = rows.withColumn("id", blank("id")).withColumn("role", F.lower(blank("role")))
    return resolve_client(rows, "id", clients, "dst")


def _node(clients: DataFrame) -> DataFrame:
    """client_idx, uid, individual and the attributes an edge copies from its client."""
    ind = _individual(clients)
    have = set(clients.columns)
    value = lambda c: blank(c) if c in have else F.lit("")
    cols = {c: value(c) for c in ATTRIBUTES}
    parts = words(blank("name"), r"\s+")
    no_name = ind & (cols["first_name"] == "") & (cols["last_name"] == "")
    cols["first_name"] = F.when(no_name, F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))).otherwise(cols["first_name"])
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    cols["last_name"] = F.when(no_name, rest).otherwise(cols["last_name"])
    uid = client_uid(F.col("id") if "id" in have else F.lit(""), ind, value("ein"), value("ssn"))
    cols["name"] = F.coalesce(present("name"), F.nullif(uid, F.lit("")), F.lit(""))
    return clients.select("client_idx", uid.alias("uid"), ind.alias("individual"), *[v.alias(k) for k, v in cols.items()])


def _edges_to(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach the dst client's copied attributes to (src, dst, role, pos) rows."""
    n = nodes.select(F.col("client_idx").alias("dst"), F.col("uid").alias("id"), *ATTRIBUTES)
    return pairs.join(n, "dst").select("src", "dst", "pos", "id", "role", *ATTRIBUTES)


def merge_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by (src, dst): incoming role always, its non-empty contact fields, blanks filled."""
    inc = first_per_key(incoming, ["src", "dst"], ["pos"])
    inc = inc.select("src", "dst", F.struct(*[c for c in inc.columns if c not in ("src", "dst")]).alias("__new"))
    old = existing.filter(F.col("dst").isNotNull()).join(inc, ["src", "dst"], "left")
    have = set(inc.schema["__new"].dataType.names)

    def field(c: str) -> Column:
        if c not in have:
            return F.col(c)
        new, cur = F.nullif(F.col("__new")[c], F.lit("")), F.nullif(F.col(c), F.lit(""))
        return F.coalesce(new, cur, F.lit("")) if c in INCOMING_WINS else F.coalesce(cur, new, F.lit(""))

    merged = {c: field(c) for c in ATTRIBUTES if c in existing.columns}
    merged["role"] = F.coalesce("__new.role", "role")
    updated = old.select(*[merged.get(c, F.col(c)).alias(c) for c in existing.columns])
    fresh = inc.join(existing.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "__new.*")
    unlinked = existing.filter(F.col("dst").isNull())
    return updated.unionByName(fresh, allowMissingColumns=True).unionByName(unlinked)


def link(edges: DataFrame, clients: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add or update both directions of (a, b, role); roles follow the kinds of the two ends."""
    nodes = _node(clients)
    kinds = nodes.select("client_idx", "individual")
    p = (
        pairs.join(kinds.withColumnsRenamed({"client_idx": "a", "individual": "ai"}), "a")
        .join(kinds.withColumnsRenamed({"client_idx": "b", "individual": "bi"}), "b")
    )
    fwd, back = link_roles(F.col("ai"), F.col("bi"), "role")
    big = F.lit(1 << 30)
    both = p.select(F.col("a").alias("src"), F.col("b").alias("dst"), fwd.alias("role"), big.alias("pos")).unionByName(
        p.select(F.col("b").alias("src"), F.col("a").alias("dst"), back.alias("role"), big.alias("pos"))
    )
    return merge_edges(edges, _edges_to(both, nodes))


def unlink(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drop both directions of (a, b)."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    return edges.join(both.distinct(), ["src", "dst"], "left_anti")


def _one_way(edges: DataFrame) -> DataFrame:
    """Edges between two known clients whose reverse does not exist."""
    known = edges.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    reverse = known.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return known.join(reverse, ["src", "dst"], "left_anti")


def missing_back_links(edges: DataFrame) -> DataFrame:
    """(src, dst, role, pos) of every back edge that should exist; the first forward edge decides."""
    lone = first_per_key(_one_way(edges).select("src", "dst", "pos", "role"), ["src", "dst"], ["pos"])
    return lone.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), inverse_role("role").alias("role"), F.lit(1 << 30).alias("pos")
    )


def add_missing_back_links(edges: DataFrame, clients: DataFrame) -> DataFrame:
    """Give every edge its reverse, carrying the inverse role and the source client's fields."""
    return edges.unionByName(_edges_to(missing_back_links(edges), _node(clients)), allowMissingColumns=True)


def drop_one_way_links(edges: DataFrame, clients: DataFrame) -> DataFrame:
    """Remove edges to known clients that do not link back; unknown targets and self-links stay.

    A client without id, EIN and SSN cannot be linked back, so its edges stay too.
    """
    named = _node(clients).filter("uid != ''").select(F.col("client_idx").alias("src"))
    lone = _one_way(edges).select("src", "dst").distinct().join(named, "src", "left_semi")
    return edges.join(lone, ["src", "dst"], "left_anti")


def drop_links_to(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Remove edges of and to deleted clients (client_idx)."""
    gone = deleted.select("client_idx").distinct()
    kept = edges.join(gone.withColumnRenamed("client_idx", "dst"), "dst", "left_anti")
    return kept.join(gone.withColumnRenamed("client_idx", "src"), "src", "left_anti").select(*edges.columns)


def refresh_link_attributes(edges: DataFrame, clients: DataFrame) -> DataFrame:
    """Copy every client's current fields onto the edges that point at it."""
    n = _node(clients).select(F.col("client_idx").alias("dst"), *[F.col(c).alias(f"__{c}") for c in ATTRIBUTES])
    out = edges.join(n, "dst", "left")
    have = [c for c in ATTRIBUTES if c in edges.columns]
    return out.select(*[F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)).alias(c) if c in have else F.col(c) for c in edges.columns])


def canonicalize_links(edges: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewrite legacy ids as `ein:`/`ssn:` keys; second result counts scanned, updated, touched, unresolved."""
    have = set(clients.columns)
    value = lambda c: F.col(c) if c in have else F.lit("")
    canon = clients.select(
        F.col("client_idx").alias("dst"), canonical_key(_individual(clients), value("ein"), value("ssn")).alias("__canon")
    )
    already = F.col("id").startswith("ein:") | F.col("id").startswith("ssn:")
    out = edges.join(canon, "dst", "left").withColumn(
        "__new", F.when(already, F.col("id")).otherwise(F.nullif("__canon", F.lit("")))
    )
    changed = F.col("__new").isNotNull() & (F.col("__new") != F.col("id"))
    stats = out.agg(
        F.count("*").alias("scanned"),
        F.count_if(changed).alias("updated"),
        F.count_distinct(F.when(changed, F.col("src"))).alias("touched"),
        F.count_if(F.col("__new").isNull() & (F.col("id") != "")).alias("unresolved"),
    )
    fixed = out.withColumn("id", F.coalesce("__new", "id")).select(*edges.columns)
    return fixed, stats


def apply_reciprocal(people: DataFrame, clients: DataFrame) -> DataFrame:
    """Write each linker's key on the matching person of the client it links to.

    `people`: client_idx, list_rank, pos, first_name, last_name, email, phone, linked_client_id.
    """
    linkers = people.filter(blank("linked_client_id") != "")
    aimed = resolve_client(linkers, "linked_client_id", clients, "__to").filter(F.col("__to").isNotNull())
    nodes = _node(clients).select(F.col("client_idx").alias("__from"), "uid")
    probe = aimed.withColumn("__from", F.col("client_idx")).withColumn("__no", F.struct("client_idx", "list_rank", "pos"))
    a = probe.select(F.col("__to").alias("client_idx"), "__no", "__from", "first_name", "last_name", "email", "phone")
    # The linker's own place becomes the probe's identity inside the target client.
    hits = find_person(
        a.select("client_idx", F.to_json("__no").alias("list_rank"), F.lit(0).alias("pos"), "first_name", "last_name", "email", "phone"), people
    )
    back = (
        hits.join(a.select(F.to_json("__no").alias("a_rank"), "__from").distinct(), "a_rank")
        .join(nodes, "__from")
        .filter(F.col("uid") != "")
        .groupBy("client_idx", F.col("b_rank").alias("list_rank"), F.col("b_pos").alias("pos"))
        .agg(F.max_by("uid", "a_rank").alias("__ref"))
    )
    out = people.join(back, ["client_idx", "list_rank", "pos"], "left")
    return out.withColumn("linked_client_id", F.coalesce("__ref", "linked_client_id")).select(*people.columns)


def relation_view(edges: DataFrame, clients: DataFrame) -> DataFrame:
    """Every edge with the linked client's current name, stored label as fallback, and role text added."""
    n = _node(clients).select(
        F.col("client_idx").alias("dst"),
        F.when(F.col("individual"), F.trim(F.concat_ws(" ", "first_name", "last_name"))).otherwise(F.col("name")).alias("__now"),
    )
    out = edges.join(n, "dst", "left")
    label = F.col("linked_client_label") if "linked_client_label" in edges.columns else F.lit("")
    person = F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "first_name", "last_name")), F.lit("")), present("name"))
    shown = F.when(F.col("id") != "", F.coalesce(F.nullif("__now", F.lit("")), present(label), present("name"))).otherwise(person)
    role = F.when(F.col("role").isin("business owner", "businessowner"), "Business Owner").when(
        F.col("role") != "", F.concat(F.upper(F.substring("role", 1, 1)), F.substr("role", F.lit(2)))
    ).otherwise("Relation")
    return out.select(*edges.columns, F.coalesce(shown, F.lit("")).alias("entity_name"), role.alias("role_text"))


def edges_to_relations(edges: DataFrame) -> DataFrame:
    """(client_idx, relations): edges folded back into one array per client, linked rows first.

    The result is the client's own list, so its size is the list's size.
    """
    fields = ["id", "role", *[c for c in ATTRIBUTES if c in edges.columns]]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o", "pos", "id", "r"))), lambda x: x["r"])
    flat = edges.select("src", (F.col("id") == "").alias("o"), "pos", "id", F.struct(*fields).alias("r"))
    return flat.groupBy(F.col("src").alias("client_idx")).agg(rows.alias("relations"))
