"""Bounded samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, per_label: bool) -> DataFrame:
    """(doc_id, text, y): at most `rows` labelled documents (of each label, if per_label) of at most `chars` characters.

    The rows of smallest id hash are taken, so the sample is the same on every run. Ids are drawn from
    the narrow label table; at most 2 * rows ids are broadcast to read their texts. Rows without id,
    label or text are left out.
    """
    marked = labels.filter(f"doc_id is not null and {label} in (0, 1)").select("doc_id", F.col(label).cast("int").alias("y"))
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if per_label:
        picks = [marked.filter(F.col("y") == y).orderBy(*order).limit(rows) for y in (0, 1)]
        pick = picks[0].unionByName(picks[1])
    else:
        pick = marked.orderBy(*order).limit(rows)
    texts = docs.filter("text is not null").filter(F.length("text") <= chars).select("doc_id", "text")
    found = texts.join(F.broadcast(pick), "doc_id")
    return cut_lineage(found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("n = 1").select("doc_id", "text", "y"))
