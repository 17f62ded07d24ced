"""Work items, sessions and logs: one feed, rollups, upserts, and event replay.

Tables: work_items(client_idx, id, task_name, status, note, created_at, started_at, held_at,
completed_at, updated_at), logs(client_idx, pos, ts, user, text, done, edited, log_type),
active(client_idx, work_item_id, task_name, started_at, created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.labels import TASK_KINDS, plural_label, task_label
from ledgerloom.functions.text import blank, norm_minute, norm_text, note_append, present, preview, split_history_text, tokenize
from ledgerloom.operators.replay import ACTIONS, judge_events
from ledgerloom.plans.ordered import Scan, block_of, first_per_key, scan
from ledgerloom.plans.session import cut_lineage

OPEN_STATES = ("active", "on_hold")
DASH = "—"


def _or_dash(*cols: str) -> Column:
    return F.coalesce(*[present(c) for c in cols], F.lit(DASH))


def sort_time(ts: str) -> Column:
    """Timestamp of either spelling; unreadable text sorts first."""
    text = F.replace(F.replace(blank(ts), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    # A trailing mark such as "(Edited)" is not part of the time.
    stamp = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}(?::\d{2})?)?)", 1)
    return F.coalesce(stamp.try_cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def union_worklog(work_items: DataFrame, logs: DataFrame, active: DataFrame) -> DataFrame:
    """Active sessions, work items and logs as one feed; a history line repeating a finished item is hidden."""
    def feed(df: DataFrame, kind: str, status: Column, task: Column, time: Column, note: Column, tag: Column, ref: Column) -> DataFrame:
        return df.select(
            "client_idx", F.lit(kind).alias("kind"), status.alias("status"), task.alias("task"), time.alias("time_disp"),
            note.alias("note_disp"), tag.alias("tag"), ref.cast("string").alias("ref"),
        )

    act = feed(active, "active", F.lit("Active"), _or_dash("task_name"), _or_dash("started_at", "created_at"), F.lit(""), F.lit("task"), F.col("work_item_id"))
    current = active.select("client_idx", F.trim("work_item_id").alias("id")).filter(F.col("id") != "").distinct()
    state = F.lower(blank("status"))
    running = work_items.filter(state == "active").join(current, ["client_idx", "id"], "left_anti")
    note = F.trim(F.replace(F.coalesce("note", F.lit("")), F.lit("\n"), F.lit(" ")))
    name, wid = _or_dash("task_name"), F.col("id")
    parts = [
        act,
        feed(running, "work", F.lit("Active"), name, _or_dash("started_at", "updated_at", "created_at"), note, F.lit("task"), wid),
        feed(work_items.filter(state == "on_hold"), "work", F.lit("On hold"), name, _or_dash("held_at", "updated_at"), note, F.lit("task"), wid),
        feed(work_items.filter(state == "completed"), "work", F.lit("Finished"), name, _or_dash("completed_at", "updated_at"), note, F.lit("finished"), wid),
    ]
    edited = F.coalesce("edited", F.lit(False)) if "edited" in logs.columns else F.lit(False)
    shown = F.when(edited, F.trim(F.concat(blank("ts"), F.lit(" (Edited)")))).otherwise(blank("ts"))
    is_history = F.lower(blank("log_type")) == "history"
    head, tail = split_history_text("text")
    finished = work_items.filter((state == "completed") & (blank("task_name") != "")).select(
        "client_idx", F.lower(F.trim("task_name")).alias("__t"), norm_minute(F.coalesce(present("completed_at"), present("updated_at"))).alias("__m")
    ).distinct()
    history = logs.filter(is_history).withColumns({"__t": F.lower(head), "__m": norm_minute("ts")})
    history = history.join(finished, ["client_idx", "__t", "__m"], "left_anti")
    done = F.coalesce("done", F.lit(False))
    parts.append(feed(history, "history", F.lit("Finished"), F.coalesce(F.nullif(head, F.lit("")), F.lit(DASH)), shown, tail, F.lit("finished"), F.col("pos")))
    parts.append(
        feed(
            logs.filter(~is_history), "memo", F.when(done, "N/A ✓").otherwise("N/A"), _or_dash("text"), shown, F.lit(""),
            F.when(done, "done").otherwise("active"), F.col("pos"),
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("sort_ts", sort_time("time_disp"))


def sort_logs(feed: DataFrame) -> DataFrame:
    return feed.orderBy(F.desc("sort_ts"), "client_idx", "kind", "ref")


def search_logs(feed: DataFrame, q: str = "", manager: str = "All", done: str = "All") -> DataFrame:
    """Feed rows holding every token; manager is exact, done applies to memo rows only.

    The feed carries client_name and acct_mgr.
    """
    out = feed
    if manager != "All":
        out = out.filter(blank("acct_mgr") == manager)
    if done in ("Done", "Open"):
        out = out.filter((F.col("kind") != "memo") | ((F.col("tag") == "done") == F.lit(done == "Done")))
    if q.strip():
        hay = F.concat_ws(" ", *[norm_text(c) for c in ("client_name", "task", "note_disp", "time_disp", "acct_mgr")])
        tokens = tokenize(F.lit(q))
        out = out.filter((F.size(tokens) == 0) | F.forall(tokens, lambda t: F.contains(hay, t)))
    return out


def held_summary(work_items: DataFrame) -> DataFrame:
    """(client_idx, summary): on-hold items per task name, counted, pluralized and joined A to Z.

    The joined list follows distinct task names, not rows.
    """
    held = work_items.filter((F.lower(blank("status")) == "on_hold") & (blank("task_name") != ""))
    counts = held.groupBy("client_idx", F.trim("task_name").alias("task")).agg(F.count("*").alias("n"))
    item = F.struct(F.lower("task").alias("k"), F.col("task").alias("t"), plural_label(F.col("task"), F.col("n")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), ", ")
    return counts.groupBy("client_idx").agg(text.alias("summary"))


def unchecked_counts(logs: DataFrame) -> DataFrame:
    """(client_idx, unchecked_logs, unchecked_memos); the first existing flag decides."""
    flags = [F.col(c) for c in ("checked", "is_checked", "done", "is_done") if c in logs.columns]
    open_ = ~F.coalesce(*flags, F.lit(False))
    kind = F.lower(blank("log_type"))
    return logs.groupBy("client_idx").agg(
        F.count_if(open_ & (kind != "memo")).alias("unchecked_logs"),
        F.count_if(open_ & kind.isin("memo", "")).alias("unchecked_memos"),
    )


def task_options(clients: DataFrame, work_items: DataFrame) -> DataFrame:
    """Selectable tasks per client: every predefined kind, then its held items with a preview."""
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("kind")) for i, k in enumerate(TASK_KINDS)]))
    fixed = clients.select("client_idx", kinds.alias("k")).select(
        "client_idx", F.lit("kind").alias("source"), F.col("k.ord").cast("bigint").alias("ord"), task_label(F.col("k.kind")).alias("label"), F.lit("").alias("work_item_id")
    )
    note = preview("note", 30)
    label = F.concat(
        F.lit("Held ("), _or_dash("held_at", "updated_at"), F.lit(") "), F.trim("task_name"),
        F.when(note == "", "").otherwise(F.concat(F.lit(" | "), note)),
    )
    held = work_items.filter((F.lower(blank("status")) == "on_hold") & (blank("task_name") != "")).select(
        "client_idx", F.lit("held").alias("source"), F.lit(len(TASK_KINDS)).cast("bigint").alias("ord"), label.alias("label"), F.col("id").alias("work_item_id")
    )
    return fixed.unionByName(held.join(clients.select("client_idx"), "client_idx", "left_semi"))


def work_item_upsert(items: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Apply one change per task: by id, else to the first open item of the same name, else as a new item.

    changes: client_idx, id (blank when unknown), task_name, status, note, new_id.
    """
    stamp = F.lit(now)
    ch = changes.withColumn("__tn", F.lower(blank("task_name"))).withColumn("__no", F.monotonically_increasing_id())
    ch = cut_lineage(ch)
    mine = items.withColumn("__tn", F.lower(blank("task_name")))
    by_id = ch.filter(blank("id") != "").join(mine.select("client_idx", "id").distinct(), ["client_idx", "id"], "left_semi").select("__no", F.col("id").alias("__target"))
    named = ch.join(by_id, "__no", "left_anti")
    open_ = mine.filter(F.lower(blank("status")).isin(*OPEN_STATES))
    first_open = open_.groupBy("client_idx", "__tn").agg(F.min_by("id", F.struct("pos", "id") if "pos" in items.columns else F.col("id")).alias("__target"))
    by_name = named.join(first_open, ["client_idx", "__tn"]).select("__no", "__target")
    hits = ch.join(by_id.unionByName(by_name), "__no", "left")
    upd = hits.filter(F.col("__target").isNotNull()).select(
        "client_idx", F.col("__target").alias("id"), F.struct("task_name", "status", "note").alias("__c")
    )
    out = items.join(upd, ["client_idx", "id"], "left")
    go, status = F.col("__c").isNotNull(), F.col("__c.status")

    def value(c: str) -> Column:
        on = {"started_at": "active", "held_at": "on_hold", "completed_at": "completed"}
        if c in on:
            return F.when(go & (status == on[c]), stamp).otherwise(F.col(c))
        if c == "updated_at":
            return F.when(go, stamp).otherwise(F.col(c))
        if c == "created_at":
            return F.when(go, F.coalesce(present("created_at"), stamp)).otherwise(F.col(c))
        if c == "note":
            return F.when(go, F.coalesce(F.nullif(F.col("__c.note"), F.lit("")), F.col("note"), F.lit(""))).otherwise(F.col(c))
        return F.coalesce(F.col(f"__c.{c}"), F.col(c)) if c in ("task_name", "status") else F.col(c)

    kept = out.select(*[value(c).alias(c) for c in items.columns])
    new = hits.filter(F.col("__target").isNull())
    when = lambda s: F.when(F.col("status") == s, stamp).otherwise("")
    made = {
        "id": F.col("new_id"), "note": F.coalesce("note", F.lit("")), "created_at": stamp, "updated_at": stamp,
        "started_at": when("active"), "held_at": when("on_hold"), "completed_at": when("completed"),
    }
    types = dict(items.dtypes)
    fresh = new.select(*[(made[c] if c in made else F.col(c) if c in new.columns else F.lit(None)).cast(types[c]).alias(c) for c in items.columns])
    return kept.unionByName(fresh)


def replay_work_events(events: DataFrame, slices: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final (work items, active sessions, history lines) after an event log, for all clients at once.

    events: client_idx, seq, ts, action, task_name, note.  A client has one active task; an
    action whose precondition fails is ignored (`replay.judge_events`, on as many ranges as
    `slices` says, whatever the size of a client).
    """
    base = events.withColumn("task", F.lower(blank("task_name"))).filter(F.col("action").isin(*ACTIONS))
    return _outcome(cut_lineage(judge_events(base, slices)))


def _outcome(valid: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = F.col("action")
    key = ["client_idx", "item"]
    # A start on a finished, removed or unknown task opens a new item of that name.
    fresh = (a == "start") & ~F.coalesce(F.col("status").isin(*OPEN_STATES), F.lit(False))
    # Suspending replaces the note; hold and finish append to it.
    resets = fresh | (a == "suspend_all")
    run = scan(
        valid, key, ["seq"], [block_of("seq")],
        {"gen": Scan("sum", F.when(fresh, 1).otherwise(0)), "__wipe": Scan("last", F.when(resets, F.col("seq")))},
    )
    last_wipe = run.groupBy(*key, "gen").agg(F.max("__wipe").alias("__from"))
    noted = run.join(last_wipe, [*key, "gen"], "left")
    text = F.when(a == "suspend_all", "Auto-held on app exit").when(a.isin("hold", "finish", "finish_held"), present("note"))
    counts = text.isNotNull() & (F.col("seq") >= F.coalesce("__from", F.lit(-1)))
    at = lambda *acts: F.max_by("ts", F.when(a.isin(*acts), F.col("seq")))
    items = noted.groupBy(*key, "gen").agg(
        F.max_by("to", "seq").alias("status"),
        F.max_by("task_name", F.when(a == "start", F.col("seq"))).alias("task_name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(counts, F.struct("seq", text.alias("t"))))), lambda x: x["t"]), "\n\n").alias("note"),
        F.min("ts").alias("created_at"),
        at("start", "resume").alias("started_at"),
        at("hold", "suspend_all", "unfinish").alias("held_at"),
        F.max_by(F.when(a.isin("finish", "finish_held"), F.col("ts")), F.when(a.isin("finish", "finish_held", "unfinish"), F.col("seq"))).alias("completed_at"),
        F.max_by("ts", "seq").alias("updated_at"),
    )
    items = items.filter(F.col("status") != "removed").withColumnRenamed("item", "task")
    active = items.filter(F.col("status") == "active").select("client_idx", "task", "task_name", "started_at")
    # A history line is undone when the next finish-or-unfinish of its task is an unfinish.
    marks = valid.filter(a.isin("finish", "finish_held", "unfinish")).withColumn("__back", -F.col("seq"))
    nxt = scan(marks, key, ["__back"], [block_of("__back")], {"__next": Scan("prev_last", F.col("action"))})
    names = run.filter(a == "start").groupBy(*key).agg(F.max_by("task_name", "seq").alias("__name"))
    lines = nxt.filter((a != "unfinish") & F.coalesce(F.col("__next") != "unfinish", F.lit(True))).join(names, key, "left")
    history = lines.select(
        "client_idx", "seq", "ts", F.concat_ws(" | ", F.coalesce("__name", "item"), present("note")).alias("text"), F.lit("history").alias("log_type")
    )
    return items, active, history


def edit_logs(logs: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply (client_idx, pos, action edit | delete | toggle, text) to memo rows, by position."""
    e = edits.select("client_idx", "pos", F.col("action").alias("__a"), F.col("text").alias("__t"))
    memo = F.lower(F.coalesce(present("log_type"), F.lit("memo"))) == "memo"
    out = logs.join(e, ["client_idx", "pos"], "left").withColumn("__go", memo & F.col("__a").isNotNull())
    out = out.filter(~(F.col("__go") & (F.col("__a") == "delete")))
    is_ = lambda s: F.col("__go") & (F.col("__a") == s)
    values = {
        "text": F.when(is_("edit"), F.coalesce("__t", "text")).otherwise(F.col("text")),
        "done": F.when(is_("toggle"), ~F.coalesce("done", F.lit(False))).otherwise(F.col("done")),
        "edited": F.when(is_("edit"), True).otherwise(F.col("edited")) if "edited" in logs.columns else None,
    }
    return out.select(*[values[c].alias(c) if values.get(c) is not None else F.col(c) for c in logs.columns])
