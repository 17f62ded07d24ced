"""Registry and the few shared table expressions of the query catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)` under a name, with the SQL that must give the same rows."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def cents(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (col.cast("decimal(18,2)") * 100).cast("bigint")


def cents_sql(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) * 100 AS BIGINT)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("day", F.to_date("o_orderdate")).withColumn("price", money("o_totalprice"))
