"""Importing one book of clients, managers, tasks and files into another.

Every merge is anti-joins and aggregations on key rows; the one sequential rule (an
incoming client blocks later ones by any of three keys) settles in parallel rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ids import ein9, manager_id, manager_key, phone10, ssn9
from ledgerloom.functions.text import blank, norm_text, present
from ledgerloom.operators.entities import _col, _individual
from ledgerloom.operators.graph import ATTRIBUTES, INCOMING_WINS
from ledgerloom.plans.ordered import first_per_key
from ledgerloom.plans.session import cut_lineage


def identity_keys(clients: DataFrame, row: str, legacy: bool = False) -> DataFrame:
    """(row, key): stored id, EIN and SSN of each client. legacy lets a lone EIN act as an SSN."""
    ein, ssn = ein9(_col(clients, "ein")), ssn9(_col(clients, "ssn"))
    spare = F.lit(True) if legacy else _individual(clients)
    ssn = F.when((ssn == "") & spare, ein).otherwise(ssn)
    tag = lambda t, v: F.when(v != "", F.concat(F.lit(t), v))
    shown = F.when(F.lit(legacy) | ~_individual(clients), ein).otherwise("")
    keys = F.array_compact(F.array(tag("id:", blank(_col(clients, "id"))), tag("ein:", shown), tag("ssn:", ssn)))
    return clients.select(row, F.explode(keys).alias("key"))


def _settle_chains(open_keys: DataFrame, row: str) -> DataFrame:
    """(row, added) of the rows whose verdict hangs on a chain of single earlier rows.

    A row that is first or second on each of its keys can be refused only by the firsts before it.
    Without any it is added; with just one its verdict is the opposite of that row's. Such rows point
    at the one before, and pointers are doubled until they reach a row without a pointer or the start.
    """
    first = open_keys.groupBy("key").agg(F.min(row).alias("__a"))
    low = open_keys.join(first, "key")
    second = low.filter(F.col(row) > F.col("__a")).groupBy("key").agg(F.min(row).alias("__b"))
    before = F.when(F.col("__a") < F.col(row), F.col("__a"))
    judged = low.join(second, "key", "left").groupBy(row).agg(
        F.bool_and(F.col(row) <= F.coalesce("__b", "__a")).alias("near"), F.min(before).alias("to"), F.max(before).alias("__hi")
    )
    single = judged.filter(F.col("near") & F.col("to").eqNullSafe(F.col("__hi")))
    # a pointer to nothing carries the verdict; one to a row says whether both verdicts are the same
    links = cut_lineage(single.select(row, "to", F.col("to").isNull().alias("same"), F.col("to").isNotNull().alias("moved")))
    while not links.filter("moved").isEmpty():
        ahead = links.select(F.col(row).alias("to"), F.col("to").alias("__to"), F.col("same").alias("__same"))
        met = F.col("__same").isNotNull()
        links = cut_lineage(
            links.join(ahead, "to", "left").select(
                row, F.when(met, F.col("__to")).otherwise(F.col("to")).alias("to"),
                F.when(met, F.col("same") == F.col("__same")).otherwise(F.col("same")).alias("same"), met.alias("moved"),
            )
        )
    return links.filter(F.col("to").isNull()).select(row, F.col("same").alias("added"))


def merge_clients(current: DataFrame, incoming: DataFrame, row: str = "row_no", legacy: bool = False) -> DataFrame:
    """Incoming rows with `outcome` added | skipped.

    A row is skipped when a current client, or an earlier incoming row that was itself
    added, holds one of its keys.  Each round settles whole chains of rows that hang on one
    earlier row each, then skips the rows which those added ones block.
    """
    taken = identity_keys(current.withColumn("__r", F.lit(0)), "__r", legacy).select("key").distinct()
    keys = cut_lineage(identity_keys(incoming, row, legacy).distinct())
    parts = [cut_lineage(keys.join(taken, "key", "left_semi").select(row).distinct().withColumn("added", F.lit(False)))]
    open_keys = cut_lineage(keys.join(parts[0], row, "left_anti"))
    while not open_keys.isEmpty():
        known = _settle_chains(open_keys, row)
        won_keys = open_keys.join(known.filter("added"), row, "left_semi").select("key").distinct()
        rest = open_keys.join(known, row, "left_anti")
        losers = cut_lineage(rest.join(won_keys, "key", "left_semi").select(row).distinct().withColumn("added", F.lit(False)))
        parts += [known, losers]
        open_keys = cut_lineage(rest.join(losers, row, "left_anti"))
    verdict = parts[0]
    for part in parts[1:]:
        verdict = verdict.unionByName(part)
    # A row without any key cannot collide and is added.
    out = incoming.join(verdict, row, "left")
    return out.withColumn("outcome", F.when(F.coalesce("added", F.lit(True)), "added").otherwise("skipped")).drop("added")


def merge_managers(current: DataFrame, incoming: DataFrame, order: str = "pos") -> DataFrame:
    """Incoming managers whose (name, email, phone) key is new, deduped, with ids."""
    key = manager_key(F.col("name"), F.col("email"), F.col("phone"))
    fresh = incoming.withColumn("__key", key).join(current.select(key.alias("__key")).distinct(), "__key", "left_anti")
    kept = first_per_key(fresh, ["__key"], [order])
    sid = F.coalesce(present("id"), manager_id(F.col("__key"))) if "id" in incoming.columns else manager_id(F.col("__key"))
    return kept.withColumn("id", sid).drop("__key")


def merge_tasks(current: DataFrame, incoming: DataFrame, clients: DataFrame, order: str = "pos") -> DataFrame:
    """New tasks with client_idx remapped through the normalized client name, first client wins."""
    blank_id = blank("id") == ""
    fresh = incoming.filter(~blank_id).join(current.select(F.trim("id").alias("id")).distinct(), "id", "left_anti")
    kept = first_per_key(fresh, ["id"], [order]).unionByName(incoming.filter(blank_id))
    names = clients.select(norm_text("name").alias("__n"), F.col("client_idx").alias("__idx")).filter(F.col("__n") != "")
    names = names.groupBy("__n").agg(F.min("__idx").alias("__idx"))
    out = kept.withColumn("__n", norm_text("client_name")).join(names, "__n", "left")
    return out.withColumn("client_idx", F.coalesce("__idx", "client_idx")).select(*incoming.columns)


def merge_files(current: DataFrame, incoming: DataFrame, mode: str, key: str = "name") -> DataFrame:
    """keep: existing files win; overwrite: incoming files win; absent: all or nothing."""
    if mode == "keep":
        return current.unionByName(incoming.join(current.select(key), key, "left_anti").select(*current.columns))
    if mode == "overwrite":
        return current.join(incoming.select(key), key, "left_anti").select(*current.columns).unionByName(incoming)
    if mode == "absent":
        return incoming if current.isEmpty() else current
    raise ValueError(f"unknown merge mode {mode!r}")


def deep_merge_fill(dst: DataFrame, src: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill null fields from src, append unseen list items, keep every other value."""
    other = src.select(*keys, F.struct(*[c for c in src.columns if c not in keys]).alias("__s"))
    out = dst.join(other, list(keys), "full_outer")
    types = dict(dst.dtypes)
    have = set(src.columns)

    def field(c: str) -> Column:
        if c in keys or c not in have:
            return F.col(c)
        new = F.col("__s")[c]
        if types[c].startswith("array"):
            unseen = F.filter(F.array_distinct(new), lambda x: ~F.coalesce(F.array_contains(F.col(c), x), F.lit(False)))
            return F.when(F.col(c).isNull(), new).when(new.isNull(), F.col(c)).otherwise(F.concat(F.col(c), unseen))
        return F.coalesce(F.col(c), new)

    return out.select(*[field(c).alias(c) for c in dst.columns])


def merge_relations(existing: DataFrame, incoming: DataFrame, owner: str = "client_idx") -> DataFrame:
    """Relation rows per owner merged by link id; unlinked people deduped by first, last and e-mail.

    Both sides: owner, pos, id, role and the copied attributes.  Linked rows sort first.
    """
    linked = F.col("id") != ""
    cols = existing.columns
    inc = incoming.filter(linked)
    # Within one side the last row of an id is the base, as later rows overwrite earlier ones.
    old = first_per_key(existing.filter(linked), [owner, "id"], ["pos"], last=True)
    inc = first_per_key(inc, [owner, "id"], ["pos"], last=True)
    new = inc.select(owner, "id", F.struct(*[c for c in cols if c not in (owner, "id")]).alias("__new"))
    # incoming rows come after all of the owner's own
    top = existing.groupBy(owner).agg((F.max("pos") + 1).alias("__top"))
    both = old.join(new, [owner, "id"], "full_outer").join(top, owner, "left")

    def field(c: str) -> Column:
        if c in (owner, "id"):
            return F.col(c)
        fresh = F.col("__new")[c]
        if c == "role":
            return F.coalesce(fresh, F.col(c))
        if c == "pos":
            return F.coalesce(F.col(c), fresh + F.coalesce("__top", F.lit(0)))
        filled, mine = F.nullif(fresh, F.lit("")), F.nullif(F.col(c), F.lit(""))
        return F.coalesce(filled, mine, F.lit("")) if c in INCOMING_WINS else F.coalesce(mine, filled, F.lit(""))

    merged = both.select(*[field(c).alias(c) for c in cols])
    people = existing.filter(~linked)
    same = [owner, "first_name", "last_name", "email"]
    extra = first_per_key(incoming.filter(~linked), same, ["pos"]).join(people.select(*same).distinct(), same, "left_anti")
    extra = extra.join(top, owner, "left").withColumn("pos", F.col("pos") + F.coalesce("__top", F.lit(0))).select(*cols)
    return merged.unionByName(people).unionByName(extra)


def relation_key(r: Column) -> Column:
    """Dedupe key of an officer or relation: its link, else name, e-mail and phone."""
    lid = F.coalesce(present(r["id"]), present(r["linked_client_id"]))
    person = F.concat_ws("|", F.lower(blank(r["name"])), F.lower(blank(r["email"])), phone10(r["phone"]))
    return F.when(lid.isNotNull(), F.concat(F.lit("link:"), lid)).otherwise(F.concat(F.lit("p:"), person))


def fold_officers(clients: DataFrame, business_links_only: bool = False) -> DataFrame:
    """Move officers into relations, first row per key kept; adds officers_moved and officers_skipped.

    With business_links_only, only rows that link to a business move and people stay officers.
    """
    empty = F.expr("array()")
    officers = F.coalesce("officers", empty)
    is_link = lambda o: (F.lower(blank(o["role"])) == "business") & (blank(o["linked_client_id"]) != "")
    moving = F.filter(officers, is_link) if business_links_only else officers
    staying = F.filter(officers, lambda o: ~is_link(o)) if business_links_only else F.filter(officers, lambda o: F.lit(False))
    rels = F.coalesce("relations", empty)
    seen = F.transform(rels, relation_key)
    fresh = F.filter(
        moving,
        lambda o, i: ~F.array_contains(seen, relation_key(o))
        & (F.array_position(F.transform(moving, relation_key), relation_key(o)) == i + 1),
    )
    return (
        clients.withColumn("__fresh", fresh)
        .withColumn("officers_moved", F.size("__fresh"))
        .withColumn("officers_skipped", F.size(moving) - F.size("__fresh"))
        .withColumn("relations", F.concat(rels, F.col("__fresh")))
        .withColumn("officers", staying)
        .drop("__fresh")
    )


def merge_client_update(current: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Overwrite plain fields, append officers, then move business-link officers to relations."""
    new = incoming.select(key, F.struct(*[c for c in incoming.columns if c != key]).alias("__new"))
    out = current.join(new, key, "full_outer")
    have = set(incoming.columns)
    empty = F.expr("array()")

    def field(c: str) -> Column:
        if c == key or c not in have:
            return F.col(c)
        fresh = F.col("__new")[c]
        if c in ("officers", "relations"):
            return F.concat(F.coalesce(F.col(c), empty), F.coalesce(fresh, empty))
        return F.coalesce(fresh, F.col(c))

    merged = out.select(*[field(c).alias(c) for c in current.columns])
    if "relations" in current.columns:
        last = lambda r, i: F.array_position(F.reverse(F.transform("relations", relation_key)), relation_key(r)) == F.size("relations") - i
        merged = merged.withColumn("relations", F.filter("relations", last))
    if {"officers", "relations"} <= set(current.columns):
        merged = fold_officers(merged, business_links_only=True).drop("officers_moved", "officers_skipped")
    return merged


def rename_task_keys(tasks: DataFrame) -> DataFrame:
    """company_* columns become client_*, filling only what is missing."""
    out = tasks
    for old in [c for c in tasks.columns if c.startswith("company_")]:
        new = "client_" + old.removeprefix("company_")
        value = F.coalesce(F.col(new), F.col(old)) if new in tasks.columns else F.col(old)
        out = out.withColumn(new, value).drop(old)
    return out


def merge_stats(outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per outcome (added, skipped, updated, not_found, ...)."""
    return outcomes.groupBy(*keys, "outcome").agg(F.count("*").alias("n"))
