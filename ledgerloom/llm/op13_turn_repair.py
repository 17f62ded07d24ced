"""Repair of conversation structure: the cheapest edits that make roles alternate, by auction shortest paths.

A conversation is a lattice: between two rows it is in one of four states (nothing yet, after system,
after user, after assistant). Keeping, rerolling or deleting a row is an arc to the next column, an
insertion an arc inside a column, all with whole-number costs. The auction algorithm keeps a price per
node, never above an arc's cost plus the price of its head; a path grows from the entry along the
cheapest head where price and cost agree, and shrinks, raising its end's price, where they do not.
When it reaches the exit the entry's price is the shortest distance, and every arc of every shortest
path is tight. The least audit string is traced through those tight arcs that lead to the exit.

Conversations may be of any length. Rows are range-partitioned and sorted by conversation and place,
and cut into chunks of at most `CHUNK` rows. Per chunk, auctions give the cost from each entry to each
exit state; a backward pass over the chunks of a conversation composes them into exit prices; with
those as costs of leaving, each chunk is solved and traced for each entry; a forward pass picks the
entry that the chunk before left in. Insertions stand before the row of a chunk that follows them, so
the traces of one chunk are no prefixes of each other and the least pieces make the least whole.
Rows cross the first shuffle without their text. "Seen earlier" is the smallest chunk that
holds a row's hash, an aggregate that combines before its shuffle. Texts are shuffled once, by
conversation, and streamed in order past the audit. That pass, like the digest made of it, is one
task per conversation but holds a batch at a time.

Cases: null role, text and the null parts of a damage key are one space; rows are taken by turn (null
first), ties by role, then by the SHA-256 of role length, role and text, so only equal rows can swap;
repeated rows are duplicates; a null conv_id is a conversation like others; a conversation
without rows has an empty audit; an empty text is blank, a very long one is read once for its flags and once when it is
written; roles count by their first character, and one that is not s, u or a can only be rerolled or
deleted; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import cut_lineage, map_arrow, table

CHUNK = 64
DELETE, INSERT, REROLE, KEEP, CUT_SHORT = 3, 2, 2, 0, 1
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: State after a row of the role that the conversation may go on with.
EXPECTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Cost of ending in a state, with the insertions that make it legal.
ENDING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
LEGAL = {"su", "ua", "au"}
INSERTED = {USER: "user", ASSISTANT: "assistant"}
BY_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


# The lattice of one chunk. A row is a letter: s, u, a, x for its role, upper case if truncated, - if it must go.


def keep_to(state: int, initial: str) -> int | None:
    """The state after keeping a row of that role, if that is legal."""
    after = BY_INITIAL.get(initial)
    return after if after == EXPECTED[state] or (state == START and after == SYSTEM) else None


def lattice(rows: str, leaving: Sequence[int]) -> tuple[list[list[tuple[str, int, int]]], list[int]]:
    """Arcs (letter, cost, head) of every node, and prices that no arc undercuts; the last node is the goal.

    Arcs that cannot lead to the goal are left out.
    """
    n = len(rows)
    goal = 4 * (n + 1)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(goal + 1)]
    ends = [c for c in leaving if c < FAR]
    price = [0] * (goal + 1)
    floor = min(ends, default=0)
    live = [False] * goal + [True]
    for s in range(4):
        price[4 * n + s] = floor
        if leaving[s] < FAR:
            arcs[4 * n + s].append(("", leaving[s], goal))
            live[4 * n + s] = True
    for i in range(n - 1, -1, -1):
        letter = rows[i]
        initial, extra = letter.lower(), CUT_SHORT * letter.isupper()
        floor += DELETE if letter == "-" else min(DELETE, extra + (KEEP if initial in BY_INITIAL else REROLE))
        for s in range(4):
            node = 4 * i + s
            price[node] = floor
            steps = [("D", DELETE, node + 4)]
            if letter != "-":
                kept = keep_to(s, initial)
                if kept is not None:
                    steps.append(("K", KEEP + extra, 4 * (i + 1) + kept))
                if kept != EXPECTED[s]:
                    steps.append(("R", REROLE + extra, 4 * (i + 1) + EXPECTED[s]))
            arcs[node] = [a for a in steps if live[a[2]]]
            live[node] = bool(arcs[node])
        for _ in range(2):  # two insertions reach every state that any number reaches
            for s in range(4):
                live[4 * i + s] |= live[4 * i + EXPECTED[s]]
        for s in range(4):
            if live[4 * i + EXPECTED[s]]:
                arcs[4 * i + s].append(("I", INSERT, 4 * i + EXPECTED[s]))
    return arcs, price


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], start: int) -> int:
    """Shortest distance from `start` to the last node; raises prices, which stay below every arc's cost plus head."""
    goal = len(arcs) - 1
    if start != goal and not arcs[start]:
        return FAR
    path = [start]
    while path[-1] != goal:
        node = path[-1]
        best, head = min((cost + price[to], to) for _, cost, to in arcs[node])
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)
    return price[start]


@lru_cache(maxsize=1 << 16)
def crossing(rows: str, first: bool, last: bool) -> tuple[int, ...]:
    """Sixteen costs, entry by entry, of crossing a chunk; a first chunk is entered at the start, a last one is left legally."""
    costs = [FAR] * 16
    for leave in range(1 if last else 4):
        leaving = [ENDING[s][0] for s in range(4)] if last else [0 if s == leave else FAR for s in range(4)]
        arcs, price = lattice(rows, leaving)
        for enter in range(1 if first else 4):
            costs[4 * enter + leave] = auction(arcs, price, enter)
    return tuple(costs)


@lru_cache(maxsize=1 << 16)
def traces(rows: str, first: bool, last: bool, leaving: tuple[int, ...]) -> list[tuple[int, int, str] | None]:
    """Per entry state (cost to the end of the conversation, exit state, least audit of the chunk)."""
    arcs, price = lattice(rows, leaving)
    goal = len(arcs) - 1
    out: list[tuple[int, int, str] | None] = [None] * 4
    for enter in range(1 if first else 4):
        cost = auction(arcs, price, enter)
        if cost >= FAR:
            continue
        tight = [[(k, to) for k, c, to in a if price[i] == c + price[to]] for i, a in enumerate(arcs)]
        ends = [False] * goal + [True]
        for column in range(len(rows), -1, -1):
            for _ in range(3):
                for node in range(4 * column, 4 * column + 4):
                    ends[node] |= any(ends[to] for _, to in tight[node])
        audit, node = [], enter
        while True:
            letter, to = min((k, to) for k, to in tight[node] if ends[to])
            if to == goal:
                break
            audit.append(letter)
            node = to
        state = node % 4
        out[enter] = (cost, state, "".join(audit) + (ENDING[state][1] if last else ""))
    return out


# From rows to chunks


def flagged(rows: DataFrame) -> DataFrame:
    """Rows with nulls as spaces, `tie` to order and recognise them, and the flags blank and cut."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    end = F.substring(F.rtrim(text, F.lit("\t\n\x0b\x0c\r ")), -1, 1)
    tie = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), tie.alias("tie"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))


ORDER = ("turn", "role", "tie")
CHUNKS = "seq long, letters string, blank array<boolean>, cut array<boolean>, ties array<binary>, illegal long, first_turn {turn}, last_turn {turn}, turns long, conv_id {conv}"


def _runs(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as chunks of one conversation and at most `size` rows each; `seq` orders the chunks of all tasks."""
    at = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    schema = None

    def chunk() -> dict:
        nonlocal at
        conv, _, _, _, blank, cut = zip(*held, strict=True)
        letters = "".join(r[2] if r[2] in BY_INITIAL else "x" for r in held)
        turns = [r[1] for r in held if r[1] is not None]
        at += 1
        return {
            "seq": at,
            "letters": letters,
            "blank": list(blank),
            "cut": list(cut),
            "ties": [r[3] for r in held],
            "illegal": sum(a + b not in LEGAL for a, b in zip(letters, letters[1:], strict=False)),
            "first_turn": min(turns, default=None),
            "last_turn": max(turns, default=None),
            "turns": len(set(turns)),
            "conv_id": conv[0],
        }

    for batch in batches:
        if schema is None:
            kind = {f.name: f.type for f in batch.schema}
            flags = pa.list_(pa.bool_())
            schema = pa.schema(
                [("seq", pa.int64()), ("letters", pa.string()), ("blank", flags), ("cut", flags), ("ties", pa.list_(pa.binary())), ("illegal", pa.int64())]
                + [("first_turn", kind["turn"]), ("last_turn", kind["turn"]), ("turns", pa.int64()), ("conv_id", kind["conv_id"])]
            )
        done = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "tie", "blank", "cut")), strict=True):
            if held and (len(held) == size or held[0][0] != row[0]):
                done.append(chunk())
                held.clear()
            held.append(row)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if held:
        yield pa.RecordBatch.from_pylist([chunk()], schema)


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Flagged rows as chunks of at most `size` rows, with what later steps need of them and no text."""
    narrow = rows.select("conv_id", "turn", "role", "tie", F.substring("role", 1, 1).alias("initial"), "blank", "cut")
    ranged = narrow.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ranged.mapInArrow(partial(_runs, size), CHUNKS.format(turn=kinds["turn"], conv=kinds["conv_id"]))


def _judged(fresh: list[bytes] | None, ties: list[bytes], letters: str, blank: list[bool], cut: list[bool]) -> tuple[str, int, int, int]:
    """The chunk's lattice rows, and how many are blank, duplicate and truncated."""
    new = set(fresh or ())
    out, blanks, repeats, short = [], 0, 0, 0
    for tie, letter, empty, open_end in zip(ties, letters, blank, cut, strict=True):
        if empty:
            blanks += 1
            out.append("-")
        elif tie not in new:
            repeats += 1
            out.append("-")
        else:
            short += open_end
            out.append(letter.upper() if open_end else letter)
        new.discard(tie)
    return "".join(out), blanks, repeats, short


JUDGED = "seq long, rows string, n_blank long, n_duplicate long, n_truncated long, costs array<long>"


def judged(chunks: DataFrame) -> DataFrame:
    """Chunks with their lattice rows, fault counts, whether they are first or last, and the costs of crossing them."""
    fresh = chunks.select("conv_id", "seq", F.explode(F.array_distinct("ties")).alias("tie")).groupBy("conv_id", "tie").agg(F.min("seq").alias("seq"))
    fresh = fresh.groupBy("seq").agg(F.collect_list("tie").alias("fresh"))
    ends = chunks.groupBy("conv_id").agg(F.min("seq").alias("a"), F.max("seq").alias("z")).drop("conv_id")
    first, last = ends.select(F.col("a").alias("seq"), F.lit(True).alias("first")), ends.select(F.col("z").alias("seq"), F.lit(True).alias("last"))
    full = chunks.join(fresh, "seq", "left").join(first, "seq", "left").join(last, "seq", "left")
    full = full.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("first", "last")})
    fields = ("seq", "fresh", "ties", "letters", "blank", "cut", "first", "last")

    def judge():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for seq, *row, first, last in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                rows, *counts = _judged(*row)
                out.append((seq, rows, *counts, crossing(rows, first, last)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        names = [c.split()[0] for c in JUDGED.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return run

    marks = map_arrow(full.select(*fields), judge, JUDGED)
    facts = full.select("seq", "conv_id", "first", "last", "illegal", F.substring("letters", 1, 1).alias("head"), F.substring("letters", -1, 1).alias("tail"), "first_turn", "last_turn", "turns")
    return cut_lineage(facts.join(marks, "seq"))


def exit_prices(chunks: DataFrame) -> DataFrame:
    """(seq, leaving): the cost from each exit state of a chunk to the end of its conversation, composed backwards."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = [0] * 4
        for batch in batches:
            seqs, found = batch.column("seq").to_pylist(), []
            for costs, last in zip(batch.column("costs").to_pylist(), batch.column("last").to_pylist(), strict=True):
                if last:
                    found.append([ENDING[s][0] for s in range(4)])
                    after = [costs[4 * s] for s in range(4)]
                else:
                    found.append(after)
                    after = [min(FAR, *(costs[4 * s + e] + after[e] for e in range(4))) for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["seq", "leaving"])

    ordered = chunks.select("conv_id", "seq", "costs", "last").repartition("conv_id").sortWithinPartitions("conv_id", F.col("seq").desc())
    return ordered.mapInArrow(back, "seq long, leaving array<long>")


def solved(chunks: DataFrame) -> DataFrame:
    """Chunks with, per entry state, the cost to the end, the exit state and the least audit."""
    kind = pa.struct([("cost", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])

    def solve():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(batch.column(c).to_pylist() for c in ("rows", "first", "last", "leaving")), strict=True)
            found = [[t and dict(zip(("cost", "state", "audit"), t, strict=True)) for t in traces(r, f, z, tuple(v))] for r, f, z, v in rows]
            return pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(found, pa.list_(kind))], ["seq", "ways"])

        return run

    full = chunks.join(exit_prices(chunks), "seq")
    ways = map_arrow(full.select("seq", "rows", "first", "last", "leaving"), solve, "seq long, ways array<struct<cost: long, state: int, audit: string>>")
    return chunks.drop("rows", "costs").join(ways, "seq")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def reports(chunks: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    fields = ["seq", "first", "last", "ways", "n_blank", "n_duplicate", "n_truncated", "illegal", "head", "tail", "first_turn", "last_turn", "turns", "conv_id"]
    conv = next(f.dataType for f in chunks.schema if f.name == "conv_id")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, audit, state, low, high, tail = [0] * 6, [], START, None, None, ""
        for batch in batches:
            done = []
            for _, first, last, ways, n_blank, n_duplicate, n_truncated, illegal, head, end, lo, hi, turns, conv_id in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if first:
                    total, audit, state, low, high, tail = [0, 0, 0, 0, 0, ways[START]["cost"]], [], START, None, None, ""
                way = ways[state]
                audit.append(way["audit"])
                state = way["state"]
                total[1] += n_blank
                total[2] += n_duplicate
                total[3] += n_truncated
                total[4] += illegal + (tail != "" and tail + head not in LEGAL)
                tail = end
                # total[0] counts distinct turns; a turn may go on in the next chunk
                total[0] += turns - (hi is not None and lo == high)
                low, high = (lo if low is None else low), (high if hi is None else hi)
                if last:
                    gaps = 0 if low is None else high - low + 1 - total[0]
                    done.append((conv_id, gaps, *total[1:], "".join(audit)))
            if done:
                kinds = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", *REPORT, "audit"])

    ordered = chunks.select(*fields).repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(forward, f"conv_id {conv.simpleString()}, {', '.join(f'{c} long' for c in REPORT)}, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one conversation after another, its audit first: the repaired rows, each conversation led by a row of place -1."""
    audit, at, state, pos, now, kinds = "", 0, START, 0, object(), None
    out: list[tuple] = []

    def insertions() -> None:
        nonlocal at, state, pos
        while audit[at : at + 1] == "I":
            state = EXPECTED[state]
            out.append((now, pos, INSERTED[state], "", "I"))
            at, pos = at + 1, pos + 1

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "pos", "role", "text", "edit"])
        out.clear()
        return made

    for batch in batches:
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        for conv, kind, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "audit", "role", "text")), strict=True):
            if conv != now:
                insertions()
                audit, at, state, pos, now = "", 0, START, 0, conv
                out.append((conv, -1, None, None, None))
            if kind == 0:
                audit = edits
            elif kind == 1:
                insertions()
                edit = audit[at]
                at += 1
                if edit != "D":
                    state = EXPECTED[state] if edit == "R" else BY_INITIAL[role[:1]]
                    out.append((conv, pos, INSERTED[state] if edit == "R" else role, text, edit))
                    pos += 1
        if out:
            yield batch_of()
    insertions()
    if out:
        yield batch_of()


def _applied(rows: DataFrame, gone: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired rows in order, conversations whole in a task, led by rows of pos -1, also for the ids of `gone`."""
    conv = next(f.dataType for f in rows.schema if f.name == "conv_id").simpleString()
    texts = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "text", *ORDER)
    heads = report.select("conv_id", F.lit(0).alias("kind"), "audit")
    marks = gone.select("conv_id", F.lit(2).alias("kind"))
    both = texts.unionByName(heads, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return ordered.select("conv_id", "kind", "audit", "role", "text").mapInArrow(_edited, f"conv_id {conv}, pos long, role string, text string, edit string")


def repair(rows: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The flagged rows, and the report of every conversation (conv_id, turn, role, text) with rows."""
    marked = flagged(rows)
    return marked, cut_lineage(reports(solved(judged(cut_lineage(chunked(marked, size))))))


def repaired_turns(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, pos, role, text, edit): the repaired conversations, edit being K, R or I."""
    marked, report = repair(rows, size)
    return _applied(marked, rows.select("conv_id").limit(0), report).filter("pos >= 0")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, now, kind = None, None, None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for conv, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")), strict=True):
            if pos < 0:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                digest, now = hashlib.sha256(), conv
            else:
                digest.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.string()), strict=True)], ["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def damaged(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the rows after damage by crc32 of `conv_id:turn`, and the rows that it drops."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(part("conv_id"), F.lit(":"), part("turn"))
    rows = convs.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    left = rows.filter("hit != 0").select("conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "hit")
    copies: Column = F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))
    return left.withColumn("copy", F.explode(copies)).drop("copy", "hit"), rows.filter("hit = 0").select("conv_id")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gone = damaged(table(spark, sf_dir, "conversations"))
    marked, report = repair(rows)
    applied = _applied(marked, gone, report)
    conv = next(f.dataType for f in rows.schema if f.name == "conv_id").simpleString()
    digests = applied.mapInArrow(_digests, f"conv_id {conv}, repaired_sha256 string").alias("d")
    out = digests.join(report.alias("r"), F.col("d.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    return out.select("d.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in REPORT], F.coalesce("audit", F.lit("")).alias("audit"), "repaired_sha256")


ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295::BIGINT)) % 20 AS hit FROM conversations, tab),
dmg AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text)) AS i, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS initial FROM dmg),
flt AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'o' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ord),
ins(p, q, made, c) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (0, 3, 'II', 4), (1, 2, 'I', 2), (1, 3, 'II', 4), (2, 3, 'I', 2), (3, 2, 'I', 2)),
said(made, q, texts) AS (VALUES ('', 0, []::VARCHAR[]), ('', 1, []), ('', 2, []), ('', 3, []), ('I', 2, ['user:']), ('I', 3, ['assistant:']), ('II', 3, ['user:', 'assistant:'])),
mov AS (SELECT p, ins.q, made, c, texts FROM ins JOIN said USING (made, q)),
opt(q, initial, z, edit, c, role) AS (VALUES (0, 's', 1, 'K', 0, NULL), (0, 'u', 2, 'K', 0, NULL), (1, 'u', 2, 'K', 0, NULL), (2, 'a', 3, 'K', 0, NULL), (3, 'u', 2, 'K', 0, NULL),
  (0, NULL, 2, 'R', 2, 'user'), (1, NULL, 2, 'R', 2, 'user'), (2, NULL, 3, 'R', 2, 'assistant'), (3, NULL, 2, 'R', 2, 'user'), (0, NULL, 0, 'D', 3, ''), (1, NULL, 1, 'D', 3, ''), (2, NULL, 2, 'D', 3, ''), (3, NULL, 3, 'D', 3, '')),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'audit': '', 'texts': []::VARCHAR[]} AS best FROM (SELECT DISTINCT conv_id FROM flt)
  UNION ALL SELECT dp.conv_id, any_value(f.i), opt.z, min({'c': dp.best.c + mov.c + opt.c + CASE WHEN f.fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END, 'audit': dp.best.audit || mov.made || edit,
    'texts': list_concat(list_concat(dp.best.texts, mov.texts), CASE WHEN edit = 'D' THEN []::VARCHAR[] ELSE [coalesce(opt.role, f.role) || ':' || f.text] END)})
  FROM dp JOIN flt f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN mov ON mov.p = dp.s JOIN opt ON opt.q = mov.q AND (opt.initial IS NULL OR opt.initial = f.initial) AND (edit = 'D' OR f.fault IN ('t', 'o')) GROUP BY dp.conv_id, opt.z),
cnt AS (SELECT conv_id, max(i) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
  count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id),
fin(s, made, c, texts) AS (VALUES (0, '', 0, []::VARCHAR[]), (1, 'II', 4, ['user:', 'assistant:']), (2, 'I', 2, ['assistant:']), (3, '', 0, [])),
ans AS (SELECT dp.conv_id, min({'c': dp.best.c + fin.c, 'audit': dp.best.audit || fin.made, 'texts': list_concat(dp.best.texts, fin.texts)}) AS best FROM dp JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM dp.conv_id AND cnt.n = dp.i JOIN fin USING (s) GROUP BY dp.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.texts, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ans ON ans.conv_id IS NOT DISTINCT FROM o.conv_id
"""
