"""Enum tables and the labels shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank, words

# State sets and tags of tracker items.
CLOSED_FILE_STATUSES = ("Received", "Not Needed", "Archived")
OPEN_ISSUE_STATUSES = ("Open", "Waiting on Client", "Waiting on Government")
STATUS_TAGS = {
    "file": {
        "Needed": "tr_needed",
        "Requested": "tr_requested",
        "Received": "tr_received",
        "Waiting on Client": "tr_waiting",
        "Waiting on Third Party": "tr_waiting",
        "Waiting on Government": "tr_waiting",
        "Not Needed": "tr_closed",
        "Archived": "tr_archived",
    },
    "reminder": {
        "Active": "tr_active",
        "Done This Year": "tr_received",
        "Inactive": "tr_closed",
        "Archived": "tr_archived",
    },
    "issue": {
        "Open": "tr_open",
        "Waiting on Client": "tr_waiting",
        "Waiting on Government": "tr_waiting",
        "Resolved": "tr_received",
        "Closed": "tr_closed",
        "Archived": "tr_archived",
    },
}
# Kinds offered for a work session, and their irregular plurals.
TASK_KINDS = (
    "PAYROLL", "BANK UPDATE", "STATEMENT OF INFORMATION", "BOOKKEEPING", "PAYROLL TAX",
    "SALES TAX", "WORKERS COMP", "MEETING", "CHILD CARE SUPPORT", "INCOME TAX",
    "BUSINESS TAX", "DOCUMENT REQUEST", "PROFIT AND LOSS", "SIMPLE IRA", "OTHER",
)
PLURALS = {
    "payroll": "Payrolls",
    "bank update": "Bank Updates",
    "statement of information": "SOI",
    "soi": "SOI",
    "bookkeeping": "Bookkeeping",
    "payroll tax": "Payroll Taxes",
    "sales tax": "Sales Taxes",
    "workers comp": "Workers Comp",
    "meeting": "Meetings",
    "child care support": "Child Care Supports",
    "income tax": "Income Taxes",
    "business tax": "Business Taxes",
    "document request": "Document Requests",
    "profit and loss": "Profit and Loss",
    "simple ira": "Simple IRAs",
    "other": "Other",
}
SUBMISSION_METHODS = ("mail", "direct_deposit")
DUE_WITHIN_DAYS = 3


def status_tag(kind: str, status: str | Column) -> Column:
    """Display tag of a tracker status; unknown states share one default."""
    s = blank(status)
    out = F.lit("tr_default")
    for value, tag in STATUS_TAGS[kind].items():
        out = F.when(s == value, tag).otherwise(out)
    return out


def task_label(kind: Column) -> Column:
    """Readable work kind: one short form, otherwise capitalized words."""
    k = F.upper(blank(kind))
    return F.when(k == "STATEMENT OF INFORMATION", "SOI").otherwise(
        F.array_join(F.transform(words(F.replace(k, F.lit("_"), F.lit(" ")), r"\s+"), F.initcap), " ")
    )


def plural_label(name: Column, count: Column) -> Column:
    """`1 Payroll`, `3 Payrolls`: fixed plurals first, then acronyms and English endings."""
    n = blank(name)
    many = (
        F.when(n.rlike("^[^a-z]*[A-Z][^a-z]*$") & F.length(n).between(2, 5), n)
        .when(F.lower(n).endswith("s"), n)
        .when(F.lower(n).endswith("y"), F.concat(F.substr(n, F.lit(1), F.length(n) - 1), F.lit("ies")))
        .otherwise(F.concat(n, F.lit("s")))
    )
    for key, text in PLURALS.items():
        many = F.when(F.lower(n) == key, text).otherwise(many)
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, n).otherwise(many))


def occurrence_tags(display: Column, done: Column, today: Column, method: Column, lead: Column) -> Column:
    """done | todo, then submission, else due when late or within three days."""
    submits = F.lower(blank(method)).isin(*SUBMISSION_METHODS) | (F.coalesce(lead, F.lit(0)) > 0)
    soon = F.date_diff(display, today) <= DUE_WITHIN_DAYS
    return (
        F.when(done, F.array(F.lit("done")))
        .when(submits, F.array(F.lit("todo"), F.lit("submission")))
        .when(soon, F.array(F.lit("todo"), F.lit("due")))
        .otherwise(F.array(F.lit("todo")))
    )
