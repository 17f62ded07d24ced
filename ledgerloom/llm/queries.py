"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ledgerloom.llm.op1_snapshots import ORACLE as SNAPSHOTS_SQL
from ledgerloom.llm.op1_snapshots import op1_snapshots
from ledgerloom.llm.op2_byte_cnn import op2_byte_cnn
from ledgerloom.llm.op3_url_trees import op3_url_trees
from ledgerloom.llm.op4_word_backoff import op4_word_backoff
from ledgerloom.llm.op5_winnowing import ORACLE as WINNOWING_SQL
from ledgerloom.llm.op5_winnowing import op5_winnowing
from ledgerloom.llm.op6_fair_queue import ORACLE as FAIR_QUEUE_SQL
from ledgerloom.llm.op6_fair_queue import op6_fair_queue
from ledgerloom.llm.op7_warc import ORACLE as WARC_SQL
from ledgerloom.llm.op7_warc import op7_warc
from ledgerloom.llm.op8_nearest_toxic import op8_nearest_toxic
from ledgerloom.llm.op9_setsketch import op9_setsketch
from ledgerloom.llm.op10_compression_bands import op10_compression_bands
from ledgerloom.llm.op11_filter_audit import ORACLE as FILTER_AUDIT_SQL
from ledgerloom.llm.op11_filter_audit import op11_filter_audit
from ledgerloom.llm.op12_line_dedup import ORACLE as LINE_DEDUP_SQL
from ledgerloom.llm.op12_line_dedup import op12_line_dedup
from ledgerloom.llm.op13_turn_repair import ORACLE as TURN_REPAIR_SQL
from ledgerloom.llm.op13_turn_repair import op13_turn_repair

OPERATORS = (
    op1_snapshots, op2_byte_cnn, op3_url_trees, op4_word_backoff, op5_winnowing,
    op6_fair_queue, op7_warc, op8_nearest_toxic, op9_setsketch, op10_compression_bands,
    op11_filter_audit, op12_line_dedup, op13_turn_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The rest is not SQL: networks, trees, neighbours, n-gram scores, sketches and compressors are tested otherwise."""
    return {
        "op1_snapshots": SNAPSHOTS_SQL, "op5_winnowing": WINNOWING_SQL, "op6_fair_queue": FAIR_QUEUE_SQL, "op7_warc": WARC_SQL,
        "op11_filter_audit": FILTER_AUDIT_SQL, "op12_line_dedup": LINE_DEDUP_SQL, "op13_turn_repair": TURN_REPAIR_SQL,
    }
