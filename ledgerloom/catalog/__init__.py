"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.catalog.registry import ORACLES, QUERIES

__all__ = ["all_queries", "all_oracles"]


def _load() -> None:
    from ledgerloom.catalog import (  # noqa: F401
        entities,
        files,
        matching,
        practice,
        reconciliation,
        scalars,
        statements,
        tasks,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
