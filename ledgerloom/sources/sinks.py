"""Writers: partitioned outputs, import files, and whole-practice bundles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import present, safe_filename
from ledgerloom.operators.graph import drop_one_way_links, edges_to_relations, explode_edges
from ledgerloom.operators.merges import merge_clients, merge_files, merge_managers, merge_stats, merge_tasks
from ledgerloom.operators.vendors import shape_output
from ledgerloom.operators.wages import wage_layout
from ledgerloom.plans.ordered import number_rows, spread_of
from ledgerloom.plans.session import cut_lineage
from ledgerloom.sources import schemas
from ledgerloom.sources.readers import normalize_clients
from ledgerloom.sources.versions import commit, current_version, new_version, observed_write, publish, read_counts, version_path

BUNDLE_PARTS = ("clients", "account_managers", "tasks", "monthly_state", "match_rules", "vendor_lists")


def with_output_file(tx: DataFrame) -> DataFrame:
    """Add the import file each transaction belongs to: company, its last month, direction."""
    last = tx.groupBy("company").agg(F.max("tx_date").alias("__last"))
    out = tx.join(last, "company", "left")
    name = safe_filename("company", F.month("__last"), F.year("__last"), F.col("direction"))
    return out.withColumn("file", name).withColumns({"year": F.year("__last"), "month": F.month("__last")}).drop("__last")


def write_matched(tx: DataFrame, path: str) -> None:
    """CSV per company, month and direction; column order differs by direction.

    Rows are range-partitioned in the order of the files, so their number decides how many part
    files a company gets.
    """
    named = with_output_file(tx)
    keys = ("company", "year", "month")
    for direction in ("debits", "credits"):
        rows = named.filter(F.col("direction") == direction)
        body = shape_output(rows, direction, keys)
        body = body.repartitionByRange(*keys, "Date", F.xxhash64(*body.columns)).sortWithinPartitions(*keys)
        body.write.mode("overwrite").partitionBy(*keys).option("header", True).csv(f"{path}/direction={direction}")


def write_wage_file(rows: DataFrame, state: str, path: str) -> None:
    """Header-less CSV in the state's column order."""
    wage_layout(rows, state).write.mode("overwrite").option("header", False).option("emptyValue", "").csv(path)


def document_register_table(docs: DataFrame) -> DataFrame:
    """name, document type, year, quarter as printed: commas become blanks, a missing quarter a dash."""
    plain = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(","), F.lit(" "))
    return docs.select(
        plain("name").alias("name"), plain("type").alias("document type"),
        F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), F.coalesce(present("quarter"), F.lit("-")).alias("quarter"),
    )


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_clients(clients: DataFrame, path: str) -> dict[str, int]:
    """Commit the book: one-way links dropped, derived fields removed, counts checked on read-back.

    The book is versioned: a failed check leaves the one before as it was; see `read_book`.
    """
    edges = drop_one_way_links(explode_edges(clients), clients)
    relations = edges_to_relations(edges).withColumnRenamed("relations", "__rel")
    body = clients.join(relations, "client_idx", "left")
    kept = body.drop("relations", "emails", "phones", "post_save_links", "version").withColumnRenamed("__rel", "relations")
    size = F.sum(F.coalesce(F.size("relations"), F.lit(0)))
    return commit(kept, path, "json", {"clients": F.count(F.lit(1)), "relations": size})


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a book that `write_clients` committed, with its positions."""
    raw = spark.read.schema(f"client_idx bigint, {schemas.CLIENTS}").json(version_path(spark, path))
    return normalize_clients(raw)


def export_bundle(tables: Mapping[str, DataFrame], path: str, selections: Mapping[str, bool] | None = None) -> list[str]:
    """One Parquet folder per chosen table in a new version, published once all are read back; logs or trackers may be emptied."""
    chosen = dict.fromkeys(tables, True) if selections is None else selections
    spark = next(iter(tables.values())).sparkSession
    version, folder = new_version(path)
    rows = {"rows": F.count(F.lit(1))}
    counts = {}
    for name, df in tables.items():
        if not chosen.get(name, False):
            continue
        empty = []
        if name == "clients":
            empty += [] if chosen.get("include_logs", True) else ["logs"]
            empty += [] if chosen.get("include_trackers", True) else ["file_requests", "annual_reminders", "client_issues"]
        types = dict(df.dtypes)
        out = df.withColumns({c: F.array().cast(types[c]) for c in empty if c in types}) if empty else df
        counts[name] = observed_write(out, f"{folder}/{name}", "parquet", rows)["rows"]
        found = read_counts(spark.read.parquet(f"{folder}/{name}"), rows)["rows"]
        if found != counts[name]:
            raise OSError(f"read-back of {name} holds {found} rows, expected {counts[name]}; {path} is unchanged")
    publish(spark, path, version, counts, list(counts))
    return list(counts)


def _added(new: DataFrame) -> tuple[DataFrame, int]:
    """Rows to add, planned once, and how many."""
    rows = cut_lineage(new)
    return rows, rows.count()


def import_bundle(spark: SparkSession, path: str, current: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Merge a bundle's current version into the tables; returns new tables and counts per part.

    Added clients take the positions after the last one, without gaps, in the bundle's order.
    """
    last = current_version(spark, path)
    tables, counts = dict(current), {}
    inc = {n: spark.read.parquet(f"{path}/version={last['version']}/{n}") for n in last["parts"]}
    if "clients" in inc:
        base = current["clients"]
        judged = cut_lineage(merge_clients(base, inc["clients"], row="client_idx"))
        added = judged.filter(F.col("outcome") == "added").drop("outcome")
        top = base.agg(F.coalesce(F.max("client_idx"), F.lit(-1)).alias("m")).first()["m"]
        seated = number_rows(added.withColumn("__g", F.lit(0)), ["__g"], ["client_idx"], [spread_of("client_idx")], "__no")
        seated = seated.withColumn("client_idx", F.col("__no") + F.lit(top)).drop("__g", "__no")
        tables["clients"] = base.unionByName(seated, allowMissingColumns=True)
        counts |= {f"clients_{r['outcome']}": r["n"] for r in merge_stats(judged).collect()}
    if "account_managers" in inc:
        new, counts["account_managers_added"] = _added(merge_managers(current["account_managers"], inc["account_managers"]))
        tables["account_managers"] = current["account_managers"].unionByName(new, allowMissingColumns=True)
    if "tasks" in inc:
        new, counts["tasks_added"] = _added(merge_tasks(current["tasks"], inc["tasks"], tables["clients"], order="id"))
        tables["tasks"] = current["tasks"].unionByName(new, allowMissingColumns=True)
    for name, mode in (("match_rules", "keep"), ("vendor_lists", "overwrite"), ("monthly_state", "absent")):
        if name in inc:
            tables[name] = merge_files(current[name], inc[name], mode) if name in current else inc[name]
            counts[f"{name}_read"] = last["counts"][name]
    return tables, counts
