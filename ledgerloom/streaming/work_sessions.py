"""Work sessions from an event stream: one open session per client, auto-hold on inactivity.

Events are applied in order of event time: rows wait in map state until the watermark has passed
them, so neither the order of arrival nor the size of a batch matters.  What one batch brings of a
client is kept as sorted runs in pages; a timer merges the pages of the runs that are due, so of each
run one page is in memory, and a client costs a few state calls per batch, not some per event.
State per client is the open task and the last event (value state), the status of each of its tasks
(map state, without removed ones), the list of its runs and the waiting pages.  A session without an
event for `timeout` is held by a timer.  What a client leaves behind is cleared when it has been
silent for `forget`.

`with_auto_holds` gives the same events to the batch form (`replay.judge_events`).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerloom.functions.text import blank
from ledgerloom.operators.replay import ACTIONS, next_status

OUTPUT = "client_idx long, seq long, ts timestamp, task string, status string, note string"
AUTO_HELD = "Auto-held on inactivity"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _struct(**fields: type) -> StructType:
    """A schema without a session, which the processor's worker has not."""
    return StructType([StructField(n, t()) for n, t in fields.items()])


SESSION = _struct(active=StringType, last_ms=LongType, last_seq=LongType)
RUN_ROWS = 1 << 13
PAGE_ROWS = 1 << 8


class Sessions(StatefulProcessor):
    """Registers of one client; times are whole milliseconds."""

    def __init__(self, timeout_ms: int, forget_ms: int) -> None:
        self.timeout, self.forget = timeout_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", SESSION)
        self.status = handle.getMapState("status", _struct(task=StringType), _struct(status=StringType))
        # [run, page, pages, first time] of each run of which rows wait
        self.runs = handle.getValueState("runs", _struct(runs=StringType))
        self.waiting = handle.getMapState("waiting", _struct(run=LongType, page=LongType), _struct(rows=StringType))

    def _read_runs(self) -> list[list[int]]:
        return json.loads(self.runs.get()[0]) if self.runs.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        runs = self._read_runs()
        first, some = None, []

        def keep() -> None:
            nonlocal first
            some.sort()
            first = some[0][0] if first is None else min(first, some[0][0])
            run = runs[-1][0] + 1 if runs else 0
            pages = range(0, len(some), PAGE_ROWS)
            for page, at in enumerate(pages):
                self.waiting.updateValue((run, page), (json.dumps(some[at : at + PAGE_ROWS]),))
            runs.append([run, 0, len(pages), some[0][0]])
            some.clear()

        for r in rows:
            some.append([r.ms, r.seq, r.action, r.task, r.note])
            if len(some) == RUN_ROWS:
                keep()
        if some:
            keep()
        if first is not None:
            self.runs.update((json.dumps(runs),))
            self.handle.registerTimer(first)
        return iter(())

    def _due(self, runs: list[list[int]], run: list[int], upto: int) -> Iterator[list]:
        """Rows of one run up to a time; what is left of it is noted in `run`, a finished run leaves `runs`."""
        number, page, pages, _ = run
        while page < pages:
            rows = json.loads(self.waiting.getValue((number, page))[0])
            n = next((i for i, row in enumerate(rows) if row[0] > upto), len(rows))
            yield from rows[:n]
            if n < len(rows):
                if n:
                    self.waiting.updateValue((number, page), (json.dumps(rows[n:]),))
                run[1], run[3] = page, rows[n][0]
                return
            self.waiting.removeKey((number, page))
            page += 1
        runs.remove(run)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        """Everything up to the watermark; the rest sets the next timer, which is due a batch later."""
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        known_client = self.session.exists()
        active, last_ms, last_seq = self.session.get() if known_client else (None, None, -1)
        runs = self._read_runs()
        due = [run for run in runs if run[3] <= upto]
        status: dict[str, str | None] = {}  # what this call has read or written; None: not known
        written: set[str] = set()

        def save() -> None:
            for task in written:
                if status[task] is None:
                    self.status.removeKey((task,))
                else:
                    self.status.updateValue((task,), (status[task],))
            written.clear()
            status.clear()

        def look(task: str) -> str | None:
            if task not in status:
                if len(status) >= RUN_ROWS:
                    save()
                status[task] = self.status.getValue((task,))[0] if self.status.containsKey((task,)) else None
            return status[task]

        def put(seq: int, ms: int, task: str, to: str, note: str) -> Row:
            look(task)
            status[task] = None if to == "removed" else to
            written.add(task)
            return Row(client_idx=key[0], seq=seq, ms=ms, task=task, status=to, note=note)

        def silence(now: int) -> Iterator[Row]:
            nonlocal active
            if active is not None and last_ms + self.timeout <= now:
                yield put(last_seq, last_ms + self.timeout, active, "on_hold", AUTO_HELD)
                active = None
            if last_ms is not None and last_ms + self.forget <= now:
                status.clear()
                written.clear()
                self.status.clear()

        for now, seq, action, task, note in heapq.merge(*[self._due(runs, run, upto) for run in due]):
            yield from silence(now)
            known = {} if (was := look(task)) is None else {task: was}
            step = next_status(action, task, active, known)
            last_ms, last_seq = now, seq
            if step is not None:
                yield put(seq, now, *step, note)
                active = step[0] if step[1] == "active" else None if step[0] == active else active
        yield from silence(upto)
        save()
        ahead = [run[3] for run in runs]
        if last_ms is None or last_ms + self.forget <= upto:
            if known_client:
                self.session.clear()
        else:
            self.session.update((active, last_ms, last_seq))
            ahead.append(last_ms + (self.timeout if active is not None else self.forget))
        if due:
            if runs:
                self.runs.update((json.dumps(runs),))
            else:
                self.runs.clear()
        if ahead:
            self.handle.registerTimer(min(ahead))

    def close(self) -> None:
        pass


def _millis(length: str) -> int:
    return int(pd.Timedelta(length).total_seconds() * 1000)


def work_sessions_stream(events: DataFrame, timeout: str = "8 hours", lateness: str = "10 minutes", forget: str = "400 days") -> DataFrame:
    """Status changes of a streaming event table (client_idx, seq, ts, action, task_name, note), in order of event time.

    Rows later than `lateness` are dropped.  A session that sees no event for `timeout` is put on
    hold at that moment.  Needs the RocksDB state store (`use_rocksdb`).
    """
    if _millis(forget) <= _millis(timeout):
        raise ValueError("a client can only be forgotten after its session has timed out")
    rows = events.withWatermark("ts", lateness).filter(F.col("action").isin(*ACTIONS))
    rows = rows.select("client_idx", "seq", "ts", F.unix_millis("ts").alias("ms"), "action", F.lower(blank("task_name")).alias("task"), F.coalesce("note", F.lit("")).alias("note"))
    out = rows.groupBy("client_idx").transformWithState(
        statefulProcessor=Sessions(_millis(timeout), _millis(forget)),
        outputStructType=StructType.fromDDL("client_idx long, seq long, ms long, task string, status string, note string"),
        outputMode="append",
        timeMode="eventTime",
    )
    return out.select("client_idx", "seq", F.timestamp_millis("ms").alias("ts"), "task", "status", "note")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def with_auto_holds(events: DataFrame, timeout: str = "8 hours") -> DataFrame:
    """The events up to the watermark's end in batch form: numbered by time, with a hold after each silence of `timeout`.

    `seq` becomes a struct of (time, kind, seq), which orders as the stream does; a hold carries the
    seq of the event before it and is ignored where no session is open.
    """
    ms = F.unix_millis("ts")
    rows = events.select("*", F.struct(ms.alias("ms"), F.lit(1).alias("kind"), F.col("seq").alias("of")).alias("__at"))
    nxt = F.lead(ms).over(Window.partitionBy("client_idx").orderBy("__at"))
    silent = rows.withColumn("__next", nxt).withColumn("__end", ms + _millis(timeout)).filter(F.coalesce(F.col("__next") >= F.col("__end"), F.lit(True)))
    holds = silent.withColumn("__at", F.struct(F.col("__end").alias("ms"), F.lit(0).alias("kind"), F.col("seq").alias("of")))
    holds = holds.withColumns({"ts": F.timestamp_millis("__end"), "action": F.lit("suspend_all"), "task_name": F.lit(""), "note": F.lit(AUTO_HELD)})
    both = rows.unionByName(holds.drop("__next", "__end"))
    return both.drop("seq").withColumnRenamed("__at", "seq")
