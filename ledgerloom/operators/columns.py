"""Column roles found from a frame's schema. Runs on the driver, reads no data."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

# Header words tried in order.
DESCRIPTION_WORDS = ("description", "desc", "details", "name", "memo", "narrative")
AMOUNT_WORDS = ("amount", "amt", "payment", "value")
PAYEE_GROUPS = (
    ("print on check as",),
    ("vendor", "vendor name"),
    ("company", "company name"),
    ("name", "payee"),
)


def _plain(name: str) -> str:
    return name.strip().lower()


def resolve_description_col(df: DataFrame) -> str:
    names = {_plain(c): c for c in reversed(df.columns)}
    if {"date", "transaction", "name", "memo", "amount"} <= names.keys():
        return names["name"]
    if "description" in names:
        return names["description"]
    ranked = [c for word in DESCRIPTION_WORDS for c in df.columns if word in _plain(c)]
    return ranked[0] if ranked else df.columns[0]


def resolve_amount_col(df: DataFrame) -> str | None:
    exact = [c for c in df.columns if _plain(c) in AMOUNT_WORDS[:2]]
    ranked = exact + [c for word in AMOUNT_WORDS for c in df.columns if word in _plain(c)]
    return ranked[0] if ranked else None


def resolve_col(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """Space-insensitive name match in candidate order, then substring in column order."""
    squeeze = lambda s: re.sub(r"\s+", "", s).lower()
    wanted = [squeeze(c) for c in candidates]
    exact = [c for w in wanted for c in df.columns if squeeze(c) == w]
    loose = [c for c in df.columns if any(w in squeeze(c) for w in wanted)]
    return next(iter(exact + loose), None)


def payee_columns(df: DataFrame) -> list[list[str]]:
    """Preferred name columns of a vendor sheet, best group first; all text columns last."""
    groups = [[c for c in df.columns if _plain(c) in group] for group in PAYEE_GROUPS]
    text = [name for name, kind in df.dtypes if kind == "string"]
    return [[c] for group in groups for c in group] + [text]
