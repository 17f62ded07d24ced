"""Replay of work events, split inside a client.

A client's register is its open task and the status of every task. What a run of events does to it is
a map, and maps compose. The map of a run is kept as the program that is left of the run when it is
evaluated without knowing the register on entry: verdicts that do not depend on the entry are
settled, their writes folded into the last one per task, and only the events that still ask something
of the entry remain, in order, between the writes they must see. Every closing event leaves no
task open whatever came before, so little remains of a long run.

The events are range-partitioned by client and place; a client that lies in several ranges has one
such program per range but the last. Running the programs one after another gives the register at
each range's start, and every range is then replayed by itself. A client inside one range needs no program.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.session import cut_lineage

OPENS, CLOSES = ("start", "resume"), {"hold": "on_hold", "finish": "completed", "suspend_all": "on_hold"}
ACTIONS = ("start", "resume", "hold", "finish", "suspend_all", "finish_held", "remove", "unfinish")
JUDGED = ("item", "status", "to")


def next_status(action: str, task: str, active: str | None, known: dict[str, str]) -> tuple[str, str] | None:
    """(task, new status) when the action is allowed, else None. Shared with the stream."""
    now = known.get(task)
    if action in OPENS:
        ok = active is None and bool(task) and (action == "start" or now == "on_hold")
        return (task, "active") if ok else None
    if action in CLOSES:
        return (active, CLOSES[action]) if active is not None else None
    rules = {
        "finish_held": (active is None and now == "on_hold", "completed"),
        "remove": (now not in (None, "removed"), "removed"),
        "unfinish": (now == "completed", "on_hold"),
    }
    ok, to = rules.get(action, (False, ""))
    return (task, to) if ok else None


class Register:
    """A client's open task and statuses, with every value known."""

    def __init__(self) -> None:
        self.active: str | None = None
        self.known: dict[str, str] = {}

    def put(self, task: str, status: str) -> None:
        self.known[task] = status
        if status == "active":
            self.active = task
        elif task == self.active:
            self.active = None

    def take(self, action: str, task: str) -> tuple[str, str | None, str] | None:
        """(item, status before, status after) of an allowed event."""
        step = next_status(action, task, self.active, self.known)
        if step is None:
            return None
        item, to = step
        before = self.known.get(item)
        self.put(item, to)
        return item, before, to


#: What may be said of the open task without the entry: nothing, or that there is one.
ANY, SOME = object(), object()


class Residue:
    """Evaluates events without the register on entry; `ops` is what then still has to be run on it.

    `known` holds statuses that no longer depend on the entry, `late` those of them that the program
    has not been told. At most one task is active, and its status says so; a task whose
    status is known otherwise is therefore not the open one.
    """

    def __init__(self) -> None:
        self.active: object = ANY
        self.known: dict[str, str] = {}
        self.late: set[str] = set()
        self.ops: list[tuple[str, str, str]] = []

    def _write(self, task: str, status: str) -> None:
        self.known[task] = status
        self.late.add(task)

    def _ask(self, action: str, task: str) -> None:
        """Leave the event to the program, which must see the writes so far that it reads."""
        if self.active not in (ANY, SOME, None):
            self._tell(self.active)
        # tasks closed here since the program last heard of them may be open there
        for other in [t for t in self.late if t == task or self.active is None]:
            self._tell(other)
        self.ops.append(("event", task, action))
        if action not in CLOSES:
            self.known.pop(task, None)

    def _tell(self, task: str) -> None:
        if task in self.late:
            self.ops.append(("status", task, self.known[task]))
            self.late.discard(task)

    def take(self, action: str, task: str) -> None:
        idle = self.active is None
        if action in CLOSES:
            if self.active in (ANY, SOME):
                self._ask(action, "")
            elif not idle:
                self._write(self.active, CLOSES[action])
            self.active = None
        elif action in (*OPENS, "finish_held"):
            held, settled = self.known.get(task) == "on_hold", task in self.known
            if self.active not in (None, ANY) or (action in OPENS and not task) or (action != "start" and settled and not held):
                return
            if idle and (action == "start" or settled):
                self._write(task, "completed" if action == "finish_held" else "active")
                self.active = self.active if action == "finish_held" else task
                return
            self._ask(action, task)
            if action == "start":
                self.active = SOME
            elif action == "resume":
                self.active = ANY
        elif task in self.known:
            if action == "remove" and self.known[task] != "removed":
                self._write(task, "removed")
                self.active = None if self.active == task else self.active
            elif action == "unfinish" and self.known[task] == "completed":
                self._write(task, "on_hold")
        else:
            self._ask(action, task)
            if action == "remove" and self.active is SOME:
                self.active = ANY

    def program(self) -> list[tuple[str, str, str]]:
        # the open task last: writing it closes no other
        for task in sorted(self.late, key=lambda t: (self.known[t] == "active", t)):
            self._tell(task)
        return [*self.ops, ("end", "", "")]


def run_program(register: Register, ops: Iterable[tuple[str, str, str]]) -> None:
    for kind, task, value in ops:
        if kind == "status":
            register.put(task, value)
        elif kind == "event":
            register.take(value, task)


def _programs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(client_idx, chunk, no, kind, task, value) of every (client, chunk) of sorted events."""
    at, left = None, None

    def told() -> pd.DataFrame:
        return pd.DataFrame([(*at, no, *op) for no, op in enumerate(left.program())], columns=["client_idx", "chunk", "no", "kind", "task", "value"])

    for pdf in batches:
        for client, chunk, action, task in zip(pdf.client_idx, pdf.chunk, pdf.action, pdf.task, strict=True):
            if (client, chunk) != at:
                if at is not None:
                    yield told()
                at, left = (client, chunk), Residue()
            left.take(action, task)
    if at is not None:
        yield told()


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(client_idx, after, task, status): the register at the end of each chunk, from the programs in order."""
    client, register = None, Register()
    for pdf in batches:
        out = []
        for c, chunk, kind, task, value in zip(pdf.client_idx, pdf.chunk, pdf.kind, pdf.task, pdf.value, strict=True):
            if c != client:
                client, register = c, Register()
            run_program(register, [(kind, task, value)])
            if kind == "end":
                out += [(c, chunk, t, s) for t, s in register.known.items()]
        yield pd.DataFrame(out, columns=["client_idx", "after", "task", "status"])


def judge_events(base: DataFrame, slices: int | None = None) -> DataFrame:
    """Allowed events with the task they are about, its status before, and its new status.

    base: client_idx, seq (distinct inside a client), action, task, and whatever else is to be kept;
    `slices` fixes the number of ranges, otherwise the session's settings do.
    """
    ranged = base.repartitionByRange(*([slices] if slices else []), "client_idx", "seq").sortWithinPartitions("client_idx", "seq")
    ranged = cut_lineage(ranged.withColumn("chunk", F.spark_partition_id()))
    spans = ranged.groupBy("client_idx", "chunk").agg(F.count("*").alias("n"))
    before = F.lag("chunk").over(Window.partitionBy("client_idx").orderBy("chunk"))
    later = cut_lineage(spans.select("client_idx", "chunk", before.alias("after")).filter("after is not null"))
    asked = ranged.join(later.select("client_idx", F.col("after").alias("chunk")), ["client_idx", "chunk"], "left_semi")
    asked = asked.select("client_idx", "chunk", "seq", "action", "task").repartition("client_idx", "chunk").sortWithinPartitions("client_idx", "chunk", "seq")
    client = dict(base.dtypes)["client_idx"]
    programs = asked.mapInPandas(_programs, f"client_idx {client}, chunk int, no long, kind string, task string, value string")
    ends = programs.repartition("client_idx").sortWithinPartitions("client_idx", "chunk", "no").mapInPandas(_entries, f"client_idx {client}, after int, task string, status string")
    known = ends.join(later, ["client_idx", "after"]).withColumn("kind", F.lit(0)).withColumn("action", F.col("status"))
    # whole numbers stay whole in pandas only without nulls
    empty = lambda n, t: (F.lit(0 if t in ("int", "bigint", "smallint", "tinyint") else None)).cast(t).alias(n)
    known = known.select(*[F.col(n) if n in known.columns else empty(n, t) for n, t in [*ranged.dtypes, ("kind", "int")]])
    rows = ranged.withColumn("kind", F.lit(1)).unionByName(known)
    names = base.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", item string, status string, to string"

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, register = None, Register()
        for pdf in batches:
            keep, found = [], []
            for i, (c, chunk, kind, action, task) in enumerate(zip(pdf.client_idx, pdf.chunk, pdf.kind, pdf.action, pdf.task, strict=True)):
                if (c, chunk) != at:
                    at, register = (c, chunk), Register()
                if kind == 0:
                    register.put(task, action)
                elif (step := register.take(action, task)) is not None:
                    keep.append(i)
                    found.append(step)
            yield pdf[names].iloc[keep].assign(**{n: [r[j] for r in found] for j, n in enumerate(JUDGED)})

    return rows.repartition("client_idx", "chunk").sortWithinPartitions("client_idx", "chunk", "kind", "seq").mapInPandas(replay, schema)
