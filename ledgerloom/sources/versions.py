"""Tables that change by whole versions: a new folder is written, checked, then named by one small file.

A table's folder holds one folder per version and `_published`, a row per commit. Readers take the
newest row, so they see the old version until the new one is written and has been read back with the
counts that were observed while it was written. Old versions stay. One writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "written bigint, version string, counts map<string,bigint>, parts array<string>"


def observed_write(df: DataFrame, path: str, fmt: str, counts: Mapping[str, Column]) -> dict[str, int]:
    """Write once and count in the same pass."""
    seen = Observation()
    df.observe(seen, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in counts.items()]).write.format(fmt).save(path)
    return dict(seen.get)


def read_counts(df: DataFrame, counts: Mapping[str, Column]) -> dict[str, int]:
    return df.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for n, c in counts.items()]).first().asDict()


def new_version(path: str) -> tuple[str, str]:
    """A fresh version name and its folder."""
    name = uuid.uuid4().hex
    return name, f"{path}/version={name}"


def current_version(spark: SparkSession, path: str) -> dict:
    """The newest commit: the storage's clock decides, the writer's breaks ties."""
    try:
        log = spark.read.schema(LOG).json(f"{path}/_published/*.json")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"{path} holds no published version") from error
    when = F.struct(F.col("_metadata.file_modification_time"), "written")
    return log.agg(F.max_by(F.struct("version", "counts", "parts"), when).alias("r")).first()["r"].asDict()


def publish(spark: SparkSession, path: str, version: str, counts: Mapping[str, int], parts: list[str]) -> None:
    """Make a version the current one: one row in one new file."""
    row = [(time.time_ns(), version, dict(counts), parts)]
    spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").json(f"{path}/_published")


def version_path(spark: SparkSession, path: str) -> str:
    """Folder of the current version."""
    return f"{path}/version={current_version(spark, path)['version']}"


def commit(df: DataFrame, path: str, fmt: str, counts: Mapping[str, Column]) -> dict[str, int]:
    """Write a version of one table, read it back, publish it; the one before stays current if they differ."""
    spark = df.sparkSession
    name, folder = new_version(path)
    want = observed_write(df, folder, fmt, counts)
    found = read_counts(spark.read.schema(df.schema).format(fmt).load(folder), counts)
    if found != want:
        raise OSError(f"read-back of {folder} holds {found}, expected {want}; {path} is unchanged")
    publish(spark, path, name, found, [])
    return found
