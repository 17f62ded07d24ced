"""File requests, reminders and issues: counts, filters, status changes, yearly roll-forward.

Tables are long: one row per item with client_idx, id, status, archived and its own fields.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import CLOSED_FILE_STATUSES, OPEN_ISSUE_STATUSES
from ledgerloom.functions.text import blank, present
from ledgerloom.plans.ordered import first_per_key

COUNTS = ("missing", "requested", "received", "open_issues", "ipp_open", "active_reminders")


def _live() -> Column:
    return ~F.coalesce("archived", F.lit(False))


def _is_open(kind: str) -> Column:
    s = blank("status")
    return {
        "file": ~s.isin(*CLOSED_FILE_STATUSES),
        "reminder": s == "Active",
        "issue": s.isin(*OPEN_ISSUE_STATUSES),
    }[kind]


def tracker_summary(files: DataFrame, reminders: DataFrame, issues: DataFrame) -> DataFrame:
    """Six counters per client over live items."""
    s, one = blank("status"), lambda c: F.when(c, 1).otherwise(0)
    ipp = blank("category") == "IPP"

    def part(df: DataFrame, **cols: Column) -> DataFrame:
        return df.filter(_live()).select("client_idx", *[cols.get(c, F.lit(0)).alias(c) for c in COUNTS])

    f = part(files, missing=one(s == "Needed"), requested=one(s == "Requested"), received=one(s == "Received"), ipp_open=one(ipp & _is_open("file")))
    r = part(reminders, active_reminders=one(_is_open("reminder")), ipp_open=one(ipp & _is_open("reminder")))
    i = part(issues, open_issues=one(_is_open("issue")), ipp_open=one(_is_open("issue") & (ipp | (blank("type") == "IPP"))))
    rows = f.unionByName(r).unionByName(i)
    return rows.groupBy("client_idx").agg(*[F.sum(c).alias(c) for c in COUNTS])


def open_tracker_items(files: DataFrame, reminders: DataFrame, issues: DataFrame) -> DataFrame:
    """(client_idx, files, reminders, issues): open live items."""
    names = {"files": (files, "file"), "reminders": (reminders, "reminder"), "issues": (issues, "issue")}
    parts = [
        df.filter(_live() & _is_open(kind)).select("client_idx", *[F.lit(int(n == name)).alias(n) for n in names])
        for name, (df, kind) in names.items()
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("client_idx").agg(*[F.sum(n).alias(n) for n in names])


def top_clients(counts: DataFrame, total: Column, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(first k clients by total then name, one row with the grand total and how many more)."""
    rows = counts.withColumn("total", total).filter(F.col("total") > 0)
    top = rows.orderBy(F.desc("total"), F.lower("name"), "client_idx").limit(k)
    rest = rows.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("grand_total"), F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return top, rest


def filter_tracker(items: DataFrame, year: str = "All", status: str = "All", category: str = "All", q: str = "") -> DataFrame:
    """Equality filters, then a case-insensitive substring over all fields."""
    out = items
    if year not in ("", "All"):
        out = out.filter(blank("tax_year") == year)
    if status not in ("", "All"):
        out = out.filter(F.col("status") == status)
    if category not in ("", "All"):
        out = out.filter(F.col("category") == category)
    if q.strip():
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in items.columns]))
        out = out.filter(F.contains(hay, F.lit(q.strip().lower())))
    return out


def collect_tax_years(today: dt.date, *tables: DataFrame) -> DataFrame:
    """Distinct years in use plus this and last year: numbers newest first, then text."""
    spark = tables[0].sparkSession
    years = spark.createDataFrame([(str(today.year),), (str(today.year - 1),)], "tax_year string")
    for t in tables:
        years = years.unionByName(t.select(blank("tax_year").alias("tax_year")))
    number = F.col("tax_year").try_cast("int")
    return years.filter(F.col("tax_year") != "").distinct().orderBy(number.isNull(), F.desc(number), F.lower("tax_year"))


def roll_forward(requests: DataFrame, from_year: str, to_year: str, now: dt.datetime) -> DataFrame:
    """New rows for to_year: live repeating requests of from_year not already there, reset.

    One row per (client, category, name); the earliest source row wins.
    """
    fy, ty = from_year.strip(), to_year.strip()
    if not fy or not ty or fy == ty:
        return requests.limit(0)
    key = [F.lower(blank("category")).alias("__c"), F.lower(blank("name")).alias("__n")]
    there = requests.filter(blank("tax_year") == ty).select("client_idx", *key).distinct()
    src = requests.filter(_live() & (blank("tax_year") == fy) & F.coalesce("repeat_next_year", F.lit(False))).select("*", *key)
    first = first_per_key(src, ["client_idx", "__c", "__n"], ["pos"])
    fresh = first.join(there, ["client_idx", "__c", "__n"], "left_anti")
    prefix = f"Rolled forward from {fy}. "
    note = F.coalesce("note", F.lit(""))
    stamp = F.lit(now.strftime("%Y-%m-%d %H:%M"))
    made = {
        "id": F.concat(F.lit("rf_"), F.substring(F.sha1(F.concat_ws("|", F.col("client_idx").cast("string"), F.lit(ty), "__c", "__n")), 1, 16)),
        "tax_year": F.lit(ty),
        "status": F.lit("Needed"),
        "requested_date": F.lit(""),
        "received_date": F.lit(""),
        "note": F.when(note == "", F.lit(prefix.strip())).when(note.startswith(prefix), note).otherwise(F.concat(F.lit(prefix), note)),
        "created_ts": stamp,
        "updated_ts": stamp,
        "archived": F.lit(False),
    }
    return fresh.select(*[made.get(c, F.col(c)).alias(c) for c in requests.columns])


def apply_tracker_patch(items: DataFrame, patches: DataFrame, now: dt.datetime) -> DataFrame:
    """Overwrite the non-null fields of a patch by id; id and created_ts never change."""
    fields = [c for c in patches.columns if c not in ("id", "created_ts")]
    p = patches.select("id", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit"))
    out = items.join(p, "id", "left")
    stamp = F.lit(now.strftime("%Y-%m-%d %H:%M"))

    def value(c: str) -> Column:
        if c == "updated_ts":
            return F.when(F.col("__hit"), stamp).otherwise(F.col(c))
        return F.coalesce(F.col(f"__{c}"), F.col(c)) if c in fields else F.col(c)

    return out.select(*[value(c).alias(c) for c in items.columns])


def apply_status(items: DataFrame, changes: DataFrame, kind: str, today: dt.date) -> tuple[DataFrame, DataFrame]:
    """Set statuses by id with their date side effects; second result is the audit log rows.

    A change that would not change anything is dropped, together with its log row.
    """
    day = F.lit(today.isoformat())
    out = items.join(changes.select("id", F.col("status").alias("__to")), "id", "left")
    old, new = blank("status"), F.col("__to")
    label = {
        "file": F.trim(F.concat_ws(" ", blank("tax_year"), blank("name"))) if kind == "file" else None,
        "issue": blank("title") if kind == "issue" else None,
        "reminder": blank("title") if kind == "reminder" else None,
    }[kind]
    say = lambda prefix: F.concat(F.lit(prefix), label)
    if kind == "file":
        changed = new.isNotNull() & (old != new)
        dates = {
            "received_date": F.when(new.isin("Needed", "Requested"), "").when(new == "Received", day).otherwise(F.col("received_date")),
            "requested_date": F.when(new.isin("Requested", "Received"), F.coalesce(present("requested_date"), day)).otherwise(F.col("requested_date")),
            "archived": F.when(new == "Archived", True).otherwise(F.col("archived")),
        }
        text = (
            F.when(new == "Requested", say("Requested tracker file: "))
            .when(new == "Received", say("Received tracker file: "))
            .when(new == "Needed", say("Set tracker file to Needed: "))
            .when(new == "Archived", F.lit("Archived tracker file request."))
        )
    elif kind == "issue":
        quiet = ((new == "Open") & old.isin(*OPEN_ISSUE_STATUSES)) | ((new == "Closed") & old.isin("Closed", "Resolved"))
        changed = new.isNotNull() & ~quiet
        dates = {
            "closed_date": F.when(new == "Open", "").when(new.isin("Closed", "Resolved"), F.coalesce(present("closed_date"), day)).otherwise(F.col("closed_date")),
            "opened_date": F.when(new == "Open", F.coalesce(present("opened_date"), day)).otherwise(F.col("opened_date")),
        }
        text = (
            F.when(new == "Open", say("Reopened tracker issue: "))
            .when(new == "Closed", say("Closed tracker issue: "))
            .when(new == "Resolved", say("Resolved tracker issue: "))
        )
    else:
        changed = new.isNotNull() & (old != new)
        dates = {"archived": F.when(new == "Active", False).otherwise(F.col("archived"))}
        text = F.when(new == "Active", say("Reactivated tracker reminder: ")).when(
            new == "Done This Year", say("Marked reminder done this year: ")
        )
    out = out.withColumn("__changed", changed)
    dates["status"] = new
    fixed = out.select(
        *[F.when(F.col("__changed"), dates[c]).otherwise(F.col(c)).alias(c) if c in dates else F.col(c) for c in items.columns]
    )
    logs = out.filter(F.col("__changed") & text.isNotNull()).select(
        "client_idx", day.alias("ts"), text.alias("text"), F.lit(False).alias("done"), F.lit("memo").alias("log_type")
    )
    return fixed, logs
