"""Client identity: keys, search, duplicates, and task ownership.

Identity rules ("id or EIN or SSN or name") never become OR-joins.  Every row emits its
keys as (kind, value) and one equi-join follows; priorities are settled by aggregation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import date_parse, quarter_start
from ledgerloom.functions.ids import digits, ein9, is_individual, manager_id, manager_key, phone10, ssn9
from ledgerloom.functions.text import blank, emails, norm_text, present, tokenize, words
from ledgerloom.plans.ordered import first_per_key

SEARCH_FIELDS = (
    "name", "dba", "entity_type", "acct_mgr", "edd_number", "sales_tax_account",
    "addr1", "addr2", "city", "state", "zip", "file_location", "memo",
)
PERSON_FIELDS = ("name", "first_name", "last_name", "nickname", "email")


def _individual(df: DataFrame) -> Column:
    flag = F.col("is_individual") if "is_individual" in df.columns else None
    return is_individual("entity_type" if "entity_type" in df.columns else F.lit(""), flag)


def _col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit("")


def client_keys(clients: DataFrame) -> DataFrame:
    """(kind, value, client_idx): first client per alias key: id, ein, ssn (or an EIN in its place)."""
    ssn = F.coalesce(F.nullif(ssn9(_col(clients, "ssn")), F.lit("")), ein9(_col(clients, "ein")))
    pairs = {"id": blank(_col(clients, "id")), "ein": ein9(_col(clients, "ein")), "ssn": ssn}
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in pairs.items()])
    rows = clients.select("client_idx", F.explode(keys).alias("k")).select("client_idx", "k.*").filter(F.col("value") != "")
    return rows.groupBy("kind", "value").agg(F.min("client_idx").alias("client_idx"))


def split_key(key: str | Column) -> dict[str, Column]:
    """`client:`, `ein:`, `ssn:` or a raw id as (kind, value)."""
    k = blank(key)
    low = F.lower(k)
    tail = F.trim(F.substring_index(k, ":", -1))
    kind = F.when(low.startswith("ein:"), "ein").when(low.startswith("ssn:"), "ssn").otherwise("id")
    value = (
        F.when(low.startswith("client:"), F.trim(F.substr(k, F.lit(8))))
        .when(low.startswith("ein:") | low.startswith("ssn:"), F.right(digits(tail), F.lit(9)))
        .otherwise(k)
    )
    return {"kind": kind, "value": value}


def resolve_client(rows: DataFrame, key: str, clients: DataFrame, out: str = "client_idx") -> DataFrame:
    """Add the position of the client each key names, or null; the first matching client wins.

    A raw key that looks like a canonical one also matches a stored id of the same text.
    """
    parts = split_key(key)
    keyed = rows.withColumns({"__kind": parts["kind"], "__value": parts["value"], "__raw": blank(key)})
    table = client_keys(clients)
    direct = table.select(F.col("kind").alias("__kind"), F.col("value").alias("__value"), F.col("client_idx").alias("__a"))
    stored = table.filter(F.col("kind") == "id").select(F.col("value").alias("__raw"), F.col("client_idx").alias("__b"))
    found = keyed.join(direct, ["__kind", "__value"], "left").join(stored, "__raw", "left")
    return found.withColumn(out, F.least("__a", "__b")).drop("__kind", "__value", "__raw", "__a", "__b")


def search_clients(clients: DataFrame, q: str, managers: Sequence[str] = ()) -> DataFrame:
    """Clients holding every query token; digit queries also hit phones and EIN ends."""
    out = clients
    text = q.strip()
    if text:
        rel = "relations" in clients.columns
        people = [
            F.array_join(F.transform("relations", lambda r, f=f: norm_text(r[f])), " ") for f in PERSON_FIELDS
        ] if rel else []
        hay = F.concat_ws(" ", *[norm_text(f) for f in SEARCH_FIELDS if f in clients.columns], *people)
        tokens = tokenize(F.lit(text))
        hit = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(hay, t))
        if text.isdigit():
            phones = F.transform("relations", lambda r: digits(r["phone"])) if rel else F.array(digits(_col(clients, "phone")))
            last10, last9 = (text[-10:], text[-9:]) if len(text) >= 4 else (text, text)
            hit = hit | F.exists(phones, lambda p: F.contains(p, F.lit(last10)))
            if "ein" in clients.columns:
                hit = hit | ein9("ein").endswith(last9)
        out = out.filter(hit)
    if managers:
        out = out.filter(F.lower(blank("acct_mgr")).isin(*[m.lower() for m in managers]))
    return out


def sort_clients(df: DataFrame) -> DataFrame:
    return df.orderBy(F.lower(F.coalesce("name", F.lit(""))), "client_idx")


def suggest(clients: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """First matches in source order as `Name — DBA — EIN` labels."""
    hits = search_clients(clients, q).orderBy("client_idx").limit(limit)
    other = lambda c, miss: F.coalesce(F.nullif(_col(clients, c), F.lit("")), F.lit(miss))
    return hits.select("client_idx", F.concat_ws(" — ", F.coalesce("name", F.lit("")), other("dba", "No DBA"), other("ein", "No EIN")).alias("label"))


def sort_mixed(df: DataFrame, col: str) -> DataFrame:
    """Numbers first in value order, then texts."""
    number = F.replace(blank(col), F.lit(","), F.lit("")).try_cast("double")
    return df.orderBy(number.isNull(), number, F.lower(blank(col)), col)


def needs_rate_refresh(clients: DataFrame, today: dt.date) -> DataFrame:
    """Clients whose last rate check is missing, unreadable, or before this quarter."""
    last = present("tax_rates_last_checked").try_cast("date")
    return clients.filter(last.isNull() | (last < quarter_start(F.lit(today))))


def company_labels(clients: DataFrame) -> DataFrame:
    """(label, key): `DBA — Name`; key is EIN, else name, else DBA; blank rows dropped."""
    name, dba, ein = present("name"), present("dba"), present("ein")
    label = F.when(dba.isNotNull(), F.concat(dba, F.lit(" — "), F.coalesce(name, F.lit("")))).otherwise(F.coalesce(name, ein))
    key = F.coalesce(ein, name, dba)
    return clients.filter(key.isNotNull()).select(label.alias("label"), key.alias("key"))


def companies_of_manager(clients: DataFrame, name: str) -> DataFrame:
    """Clients whose manager, from three possible fields, is `name`."""
    fields = [present(c) for c in ("account_manager", "account_manager_name", "acct_mgr") if c in clients.columns]
    return clients.filter(F.lower(F.coalesce(*fields, F.lit(""))) == name.strip().lower()) if name.strip() else clients.limit(0)


def link_candidates(clients: DataFrame, exclude: str | None = None) -> DataFrame:
    """Labelled link key per named client; blank id when its number is missing; first label wins."""
    ind = _individual(clients)
    number = F.when(ind, F.coalesce(F.nullif(ssn9(_col(clients, "ssn")), F.lit("")), ein9(_col(clients, "ein")))).otherwise(
        ein9(_col(clients, "ein"))
    )
    kind = F.when(ind, "SSN").otherwise("EIN")
    has = number != ""
    key = F.when(has, F.concat(F.lower(kind), F.lit(":"), number)).otherwise("")
    label = F.concat(F.trim("name"), F.lit(" — "), F.when(has, F.concat(kind, F.lit(" "), number)).otherwise(F.concat(F.lit("(Missing "), kind, F.lit(")"))))
    rows = clients.filter(blank("name") != "").select("client_idx", key.alias("id"), label.alias("label"), (~ind).alias("is_company"))
    if exclude:
        rows = rows.filter(F.col("id") != exclude)
    return first_per_key(rows, [F.lower("label")], ["client_idx"])


def duplicate_identity(clients: DataFrame) -> DataFrame:
    """Clients sharing an SSN with another individual or an EIN with another business."""
    ind = _individual(clients)
    kind = F.when(ind, "SSN").otherwise("EIN")
    number = F.when(ind, ssn9(_col(clients, "ssn"))).otherwise(ein9(_col(clients, "ein")))
    rows = clients.select("client_idx", kind.alias("kind"), number.alias("digits")).filter(F.col("digits") != "")
    shared = rows.groupBy("kind", "digits").agg(F.count("*").alias("n"), F.min("client_idx").alias("first_idx")).filter("n > 1")
    return rows.join(shared, ["kind", "digits"])


def dedupe_managers(managers: DataFrame, order: str = "pos") -> DataFrame:
    """First manager per (name, email, phone), with a stable id where none is stored."""
    key = manager_key(F.col("name"), F.col("email"), F.col("phone"))
    kept = first_per_key(managers.withColumn("__key", key), ["__key"], [order])
    sid = F.coalesce(present("id"), manager_id(F.col("__key"))) if "id" in managers.columns else manager_id(F.col("__key"))
    return kept.select(
        order, sid.alias("id"), *[blank(c).alias(c) for c in ("name", "email", "phone")]
    )


def manager_names(managers: DataFrame, order: str = "pos") -> DataFrame:
    """Case-insensitive distinct names, first spelling kept."""
    named = managers.filter(blank("name") != "")
    return named.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min_by(F.trim("name"), F.col(order)).alias("name"))


def flat_contacts(clients: DataFrame) -> DataFrame:
    """Distinct e-mails and phones of a client's relations, first-seen order."""
    mails = F.array_distinct(F.flatten(F.transform("relations", lambda r: emails(r["email"]))))
    phones = F.array_distinct(F.filter(F.transform("relations", lambda r: blank(r["phone"])), lambda p: p != ""))
    return clients.select("client_idx", mails.alias("emails"), phones.alias("phones"))


def _alias_keys(idx: Column, cid: Column, ein: Column, name: Column) -> Column:
    tag = lambda t, v: F.when(v != "", F.concat(F.lit(t), v))
    keys = F.array(tag("c:", blank(cid)), tag("e:", ein9(ein)), F.concat(F.lit("i:"), idx.cast("string")), tag("n:", F.lower(blank(name))))
    return F.array_compact(keys)


def _alias_sides(rows: DataFrame, key: str, aliases: Column, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, k) of the keys with one list of aliases, with the aliases before each; of those with several; of all."""
    listed = rows.select(F.col(key).alias(name), F.array_sort(F.array_distinct(aliases)).alias("__all"))
    ends = listed.groupBy(name).agg(F.min("__all").alias("__all"), F.max("__all").alias("__other"))
    alone = ends.filter(F.col("__all") == F.col("__other")).select(name, "__all", F.posexplode("__all").alias("__i", "k"))
    alone = alone.select(name, "k", F.slice("__all", F.lit(1), F.col("__i")).alias(f"__before_{name}"))
    several = ends.filter(F.col("__all") != F.col("__other")).select(F.col(name).alias("__key"))
    every = listed.select(name, F.explode("__all").alias("k"))
    return alone, every.join(several, F.col(name).eqNullSafe(F.col("__key")), "left_semi"), every


def tasks_for_clients(tasks: DataFrame, clients: DataFrame, enabled_only: bool = True) -> DataFrame:
    """(client_idx, task id) pairs agreeing on id, EIN, position or name.

    A pair that agrees on several aliases is kept where the first of them meets, so the pairs,
    which may be far more than the rows, are not shuffled to be made distinct.  That is done only
    for task ids or positions that come with different aliases in several rows.
    """
    if enabled_only and "is_enabled" in tasks.columns:
        tasks = tasks.filter(F.coalesce("is_enabled", F.lit(True)))
    t_idx = F.col("client_idx") if "company_idx" not in tasks.columns else F.coalesce("client_idx", "company_idx")
    t_name = F.col("client_name") if "company_name" not in tasks.columns else F.coalesce(present("client_name"), "company_name")
    t_one, t_more, _ = _alias_sides(tasks, "id", _alias_keys(t_idx, _col(tasks, "client_id"), _col(tasks, "ein"), t_name), "task_id")
    c_one, c_more, c_all = _alias_sides(clients, "client_idx", _alias_keys(F.col("client_idx"), _col(clients, "id"), _col(clients, "ein"), F.col("name")), "client_idx")
    met_before = (F.size("__before_task_id") > 0) & (F.size("__before_client_idx") > 0) & F.arrays_overlap("__before_task_id", "__before_client_idx")
    pair = ["client_idx", "task_id"]
    once = t_one.join(c_one, "k").filter(~met_before).select(*pair)
    rest = t_more.join(c_all, "k").select(*pair).unionByName(t_one.join(c_more, "k").select(*pair)).distinct()
    return once.unionByName(rest)


def resolve_task_owner(tasks: DataFrame, clients: DataFrame) -> DataFrame:
    """Rewrite client_id to the owner's EIN, else SSN: by position, then name, then stored id.

    Adds `outcome`: updated, unchanged, no_number or not_found.  A task without a key matches nothing;
    in its place stands a hash of the task, so such tasks do not all meet in one join task.
    """
    spare = F.concat(F.lit("s"), F.xxhash64(*[c for c, kind in tasks.dtypes if "map<" not in kind]).cast("string"))
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    spread = lambda c: F.when(c.cast("string") != "", key(c)).otherwise(spare)
    owner = clients.select(
        "client_idx", blank(_col(clients, "id")).alias("__id"), F.lower(blank("name")).alias("__name"),
        ein9(_col(clients, "ein")).alias("__ein"), ssn9(_col(clients, "ssn")).alias("__ssn"),
    )
    last = lambda col: owner.filter(F.col(col) != "").groupBy(key(F.col(col)).alias(col)).agg(F.max("client_idx").alias(f"__by{col}"))
    own_id = blank("client_id")
    sought = {"__idx": F.col("client_idx"), "__name": F.lower(blank("client_name")), "__id": own_id, "__ein": ein9(own_id), "__ssn": ein9(own_id)}
    rows = tasks.withColumns({col: spread(value) for col, value in sought.items()})
    rows = rows.join(owner.select(key(F.col("client_idx")).alias("__idx"), F.col("client_idx").alias("__by_idx")), "__idx", "left")
    for col in ("__name", "__id", "__ein", "__ssn"):
        rows = rows.join(last(col), col, "left")
    pick = F.coalesce("__by_idx", "__by__name", "__by__id", "__by__ein", "__by__ssn")
    numbers = owner.select(key(F.col("client_idx")).alias("__at"), F.coalesce(F.nullif("__ein", F.lit("")), F.nullif("__ssn", F.lit(""))).alias("__new"))
    rows = rows.withColumn("__owner", pick).withColumn("__at", spread(F.col("__owner"))).join(numbers, "__at", "left")
    outcome = (
        F.when(F.col("__owner").isNull(), "not_found")
        .when(F.col("__new").isNull(), "no_number")
        .when(own_id == F.col("__new"), "unchanged")
        .otherwise("updated")
    )
    out = rows.withColumn("outcome", outcome).withColumn("client_id", F.coalesce("__new", "client_id"))
    return out.select(*tasks.columns, "outcome")


def find_person(people_a: DataFrame, people_b: DataFrame) -> DataFrame:
    """For each person of A the first person of the same client in B agreeing on e-mail, phone or name.

    Both sides: client_idx, list_rank (officers, employees, spouses), pos, first_name, last_name,
    email, phone.
    """

    def keyed(df: DataFrame) -> DataFrame:
        mail, phone = F.lower(blank("email")), digits("phone")
        full = F.when((blank("first_name") != "") & (blank("last_name") != ""), F.concat_ws("\x01", blank("first_name"), blank("last_name")))
        keys = F.array_compact(
            F.array(
                F.when(mail != "", F.concat(F.lit("m:"), mail)), F.when(phone != "", F.concat(F.lit("p:"), phone)), F.concat(F.lit("f:"), full)
            )
        )
        return df.withColumn("__k", F.explode(keys))

    a = keyed(people_a).select("client_idx", F.col("list_rank").alias("a_rank"), F.col("pos").alias("a_pos"), "__k")
    b = keyed(people_b).groupBy("client_idx", "__k").agg(F.min(F.struct("list_rank", "pos")).alias("hit"))
    return a.join(b, ["client_idx", "__k"]).groupBy("client_idx", "a_rank", "a_pos").agg(F.min("hit").alias("hit")).select(
        "client_idx", "a_rank", "a_pos", F.col("hit.list_rank").alias("b_rank"), F.col("hit.pos").alias("b_pos")
    )
