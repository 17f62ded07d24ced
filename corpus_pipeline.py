"""A training corpus from raw documents: five stages, each a whole pass over what the one before kept.

Quality classifier, toxicity, near duplicates, benchmark decontamination, mixing to target weights.
Stages keep the columns of documents; the last gives the mixture: which documents a training run
takes, how many words of each, and in which order.

Cases, for every stage: a null text counts as an empty one, a null doc_id, lang or source is a value
like others; very long texts are read whole; repeated rows are rows of their own, so all or none of
them pass a classifier; columns beyond those of documents pass through all stages but the last,
except one named row_id, which the near duplicates and the decontamination number rows with and do not
give back; an empty table gives an empty table, and without labels nothing is learnt and
nothing rejected by that classifier's examples. Each stage names its own ties.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut_lineage, fold, numbered, table
from ledgerloom.llm.op2_byte_cnn import fit_quality, quality_score
from ledgerloom.llm.op5_winnowing import contamination
from ledgerloom.llm.op6_fair_queue import mixture
from ledgerloom.llm.op8_nearest_toxic import fit_toxicity, toxicity_score
from ledgerloom.llm.op9_setsketch import near_duplicates

QUALITY_FROM, TOXIC_FROM = 0.5, 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and the labels that may be learnt from."""
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~fold("doc_id", 3, 1))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores at least QUALITY_FROM; a tie with it stays. An empty text is scored as one."""
    net = fit_quality(*_training(spark, sf_dir))
    return docs.filter(quality_score(net)("text") >= QUALITY_FROM)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples vote below TOXIC_FROM; term frequencies count `docs`. A tie with it goes."""
    index = fit_toxicity(*_training(spark, sf_dir), corpus=docs)
    return docs.filter(toxicity_score(index)("text") < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest id, ties by its row; a text without words is no duplicate."""
    rows = numbered(docs)
    gone = cut_lineage(near_duplicates(rows, SHINGLE_WORDS, SIMILAR_PERCENT, F.col("row_id")).filter("not keeper").select("row_id"))
    return rows.join(gone, "row_id", "left_anti").drop("row_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a shared window of benchmark words; a text without words stays."""
    rows = numbered(docs)
    hit = cut_lineage(contamination(rows, table(spark, sf_dir, "benchmark"), row=F.col("row_id")).filter("contaminated").select("row_id"))
    return rows.join(hit, "row_id", "left_anti").drop("row_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes words of, with their words taken and virtual finish time; ties in the shuffle fall to id, size and text."""
    return mixture(docs).filter("taken > 0").drop("row_id")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL has neither the network, the nearest examples nor the sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
