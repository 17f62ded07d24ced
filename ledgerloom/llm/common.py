"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.session import cut_lineage

__all__ = ["cut_lineage", "table", "fold", "numbered", "bitmap_of", "text_rows", "map_arrow"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, parts: int, held: int) -> Column:
    """True for rows held out: crc32 of the key as text, modulo `parts`, equals `held`; false for a null key."""
    col = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % parts == held, F.lit(False))


def _is_scan(df: DataFrame) -> bool:
    """Whether the rows of `df` are rows of Parquet files, each at most once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().split()[0] in ("Relation", "LogicalRelation") and "row_index" in df.select("_metadata.*").columns


def numbered(df: DataFrame) -> DataFrame:
    """`df` with `row_id`, which is the same in every scan, however the files are cut into partitions.

    It holds the place of the row's file among the paths and that of the row in its file. A frame that
    is not a plain scan of Parquet files is written first.
    """
    rows = df if _is_scan(df) else cut_lineage(df)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = placed.select("__file").distinct()
    files = cut_lineage(files.withColumn("__number", F.row_number().over(Window.orderBy("__file")).cast("bigint")))
    return placed.join(files, "__file").withColumn("row_id", F.shiftleft("__number", 40) + F.col("__at")).drop("__file", "__number", "__at")


def bitmap_of(positions: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the values of a one-column frame of numbers below `bits`.

    The map is put together in tasks, by words of 64 bits, so the driver gets `bits` / 8 bytes and
    the word numbers, whatever the size of the frame; a full map lets everything through, so readers
    may only use it to leave out what a later join would drop.
    """
    words = positions.toDF("p").groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    full = np.zeros(-(-bits // 64), np.int64)
    full[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return np.packbits(np.unpackbits(full.view(np.uint8), bitorder="little")[:bits])


def bits_at(packed: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return ((packed[positions >> 3] >> (7 - (positions & 7)).astype(np.uint8)) & 1).astype(bool)


def text_rows(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def map_arrow(df: DataFrame, fn, schema: str, small: int = 2000) -> DataFrame:
    """`mapInArrow` over slices of at most `small` rows, so that Python holds little text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fn()
        for batch in batches:
            for at in range(0, batch.num_rows, small):
                out = state(batch.slice(at, small))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
