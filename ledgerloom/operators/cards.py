"""Company-card exports: keep food and drink, classify, and match to the expense file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import MONEY
from ledgerloom.plans.ordered import first_per_key

# Category words and the account each one books to.
EXPENSE_ACCOUNTS = (
    (("employee benefits -meals", "staff meal"), "Office Expense:Meal"),
    (("business trip",), "Travel Expense:Meals "),
    (("client meeting", "customer meeting"), "Meals and Entertainment "),
)


def expense_account(text: str | Column) -> Column:
    t = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    out = F.lit(None).cast("string")
    for marks, account in reversed(EXPENSE_ACCOUNTS):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | t.contains(mark)
        out = F.when(hit, account).otherwise(out)
    return out


def classify_expense(card: DataFrame, scope: Sequence[str], category: str) -> DataFrame:
    """Food and drink rows with a known account, in `classification`."""
    food = F.lit(False)
    for c in scope:
        food = food | F.coalesce(F.col(c).rlike(r"(?i)\b(food|drink)\b"), F.lit(False))
    return card.filter(food).withColumn("classification", expense_account(category)).filter(F.col("classification").isNotNull())


def match_card_keys(fs: DataFrame, card: DataFrame, order: Sequence[str]) -> DataFrame:
    """Expense rows with `classification`: same card, date and signed amount, else same size.

    Both sides carry last4, tx_date, amount.  The card side keeps its first row per key, so
    the expense file keeps its row count.
    """
    signed = first_per_key(
        card.select("last4", "tx_date", F.col("amount").cast(MONEY).alias("amount"), "classification", *order),
        ["last4", "tx_date", "amount"], order,
    ).select("last4", "tx_date", "amount", F.col("classification").alias("__signed"))
    sized = first_per_key(
        card.select("last4", "tx_date", F.abs("amount").cast(MONEY).alias("__abs"), "classification", *order),
        ["last4", "tx_date", "__abs"], order,
    ).select("last4", "tx_date", "__abs", F.col("classification").alias("__sized"))
    left = fs.withColumn("amount", F.col("amount").cast(MONEY)).withColumn("__abs", F.abs("amount").cast(MONEY))
    out = left.join(signed, ["last4", "tx_date", "amount"], "left").join(sized, ["last4", "tx_date", "__abs"], "left")
    return out.select(*fs.columns, F.coalesce("__signed", "__sized", F.lit("")).alias("classification"))
