"""Recurring tasks: which days they fall on, their display dates, feeds and edits.

A task row carries: id, client columns, kind, kind_other, freq, dom, dom2, weekday,
anchor_date, months, start_on, effective_from, end_on, pause_from, resume_from,
is_paused, is_enabled, due, action_lead_days, method, completed, cancelled.
Expansion is row-local: the numbers of the first and the last period that can touch the window
follow from the rule, and the day of each number in between is computed, so its cost is that of the
rows it makes, not that of the window's days.  No shuffle until a feed ranks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import clamp_day, next_monthly, next_quarterly, next_semi_monthly
from ledgerloom.functions.labels import DUE_WITHIN_DAYS, SUBMISSION_METHODS, occurrence_tags
from ledgerloom.functions.text import blank
from ledgerloom.operators.calendar import Span, display_date

PAST_DAYS, FUTURE_DAYS, PAST_CHUNK = 7, 7, 90
QUARTER_MONTHS = (1, 4, 7, 10)


def kind_label() -> Column:
    """Task kind, or the free text of an OTHER task."""
    other = blank("kind_other")
    return F.when((F.upper(blank("kind")) == "OTHER") & (other != ""), other).otherwise(F.col("kind"))


def _or(col: str, value: int) -> Column:
    return F.coalesce(F.col(col), F.lit(value))


def _freq() -> Column:
    return F.lower(F.coalesce(F.nullif(F.trim("freq"), F.lit("")), F.lit("one-off")))


def _months() -> Column:
    every = F.array(*[F.lit(m) for m in QUARTER_MONTHS])
    return F.when(F.size("months") > 0, F.col("months")).otherwise(every)


def occurs_on(day: Column) -> Column:
    """True when the task of this row falls on `day`."""
    closed = (
        (day < F.col("effective_from"))
        | (day > F.col("end_on"))
        | (day < F.col("start_on"))
        | (F.col("is_paused") & (day >= F.col("pause_from")))
        | ((F.col("pause_from") < F.col("resume_from")) & (day >= F.col("pause_from")) & (day < F.col("resume_from")))
    )
    first = F.trunc(day, "month")
    on = lambda col, default: day == clamp_day(first, _or(col, default))
    period = F.when(_freq() == "weekly", 7).otherwise(14)
    base = F.when(F.col("weekday").isNotNull(), F.coalesce("start_on", "anchor_date")).otherwise(F.col("anchor_date"))
    right_day = F.col("weekday").isNull() | (F.weekday(day) == F.col("weekday"))
    rule = (
        F.when(_freq() == "one-off", day == F.col("due"))
        .when(_freq() == "monthly", on("dom", 1))
        .when(_freq() == "semi-monthly", on("dom", 5) | on("dom2", 20))
        .when(_freq().isin("weekly", "biweekly"), right_day & (day >= base) & (F.date_diff(day, base) % period == 0))
        .when(_freq() == "quarterly", F.array_contains(_months(), F.month(day)) & on("dom", 15))
        .otherwise(False)
    )
    return ~F.coalesce(closed, F.lit(False)) & F.coalesce(rule, F.lit(False))


def _enumerated(tasks: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame:
    """`tasks` with `orig`, one row per day in [lo, hi] on which the task falls; the days that `occurs_on` accepts.

    Weeks are counted from the task's base day, months from that of the window's first open day;
    a semi-monthly task has two numbers a month.
    """
    freq = _freq()
    weekly, twice = freq.isin("weekly", "biweekly"), freq == "semi-monthly"
    low = F.greatest(F.lit(lo), F.col("effective_from"), F.col("start_on"))
    last = F.when(F.coalesce("is_paused", F.lit(False)), F.date_sub("pause_from", 1))
    high = F.least(F.lit(hi), F.col("end_on"), last)
    period = F.when(freq == "weekly", 7).otherwise(14)
    by_day = F.col("weekday").isNotNull()
    base = F.when(by_day, F.coalesce("start_on", "anchor_date")).otherwise(F.col("anchor_date"))
    # periods are whole weeks, so every day of the series has the base's weekday
    base = F.when(~by_day | (F.weekday(base) == F.col("weekday")), base)
    months = ((F.year("__high") - F.year("__low")) * 12 + F.month("__high") - F.month("__low")).cast("long")
    calendar = freq.isin("monthly", "semi-monthly", "quarterly")
    from_ = F.when(weekly, F.greatest(F.ceil(F.date_diff("__low", "__base") / period), F.lit(0))).otherwise(F.lit(0))
    to = F.when(weekly, F.floor(F.date_diff("__high", "__base") / period)).when(twice, months * 2 + 1).when(calendar, months).otherwise(F.lit(0))
    ranged = tasks.withColumns({"__low": low, "__high": high, "__base": base}).filter("__low <= __high")
    rule = {
        "__every": F.when(weekly, period),
        "__first": F.when(calendar, F.trunc(F.col("__low"), "month")),
        "__dom": F.coalesce("dom", F.when(twice, 5).when(freq == "quarterly", 15).otherwise(1)),
        "__dom2": F.when(twice, _or("dom2", 20)),
        "__months": F.when(freq == "quarterly", _months()),
        "__once": F.when(freq == "one-off", F.col("due")),
    }
    ranged = ranged.withColumns({"__from": from_.cast("int"), "__to": to.cast("int"), **rule}).filter("__from <= __to")
    rows = ranged.withColumn("__k", F.explode(F.sequence("__from", "__to")))
    k, second = F.col("__k"), F.col("__dom2").isNotNull() & (F.col("__k") % 2 == 1)
    month = F.add_months("__first", F.when(F.col("__dom2").isNotNull(), F.shiftright(k, 1)).otherwise(k))
    rows = rows.withColumn("__month", F.explode(F.array(month)))
    long = F.dayofmonth(F.last_day("__month"))
    nth, other = F.least("__dom", long), F.least("__dom2", long)
    # the second day of a month may be the first one again
    place = F.when(~second, nth).when(nth != other, other)
    place = F.when((place >= 1) & F.coalesce(F.array_contains("__months", F.month("__month")), F.col("__months").isNull()), place)
    day = F.coalesce("__once", F.date_add("__base", k * F.col("__every")), F.date_add("__month", place - 1))
    rows = rows.withColumn("orig", F.explode(F.array(day)))
    gap = (F.col("pause_from") < F.col("resume_from")) & (F.col("orig") >= F.col("pause_from")) & (F.col("orig") < F.col("resume_from"))
    rows = rows.filter(F.col("orig").between(F.col("__low"), F.col("__high")) & ~F.coalesce(gap, F.lit(False)))
    return rows.drop("__low", "__high", "__base", "__from", "__to", "__k", "__month", *rule)


def expand_occurrences(
    tasks: DataFrame, start: dt.date, end: dt.date, buffer: int = 10, done_by: str = "either"
) -> DataFrame:
    """One row per (task, orig) in [start - buffer, end + buffer], with display date and states.

    `done_by` is "either" (original or display date closes it) or "orig".
    """
    lo, hi = start - dt.timedelta(days=buffer), end + dt.timedelta(days=buffer)
    rows = _enumerated(tasks, lo, hi)
    far = tasks.agg(F.max("action_lead_days")).first()[0] or 0
    rows = display_date(rows, "orig", "action_lead_days", "disp", Span(lo, hi, max(0, far)))
    none = F.array().cast("array<date>")

    def held(col: str) -> Column:
        bag = F.coalesce(F.col(col), none)
        hit = F.array_contains(bag, F.col("orig"))
        return hit | F.array_contains(bag, F.col("disp")) if done_by == "either" else hit

    return rows.withColumn("is_done", held("completed")).withColumn("is_cancelled", held("cancelled"))


def next_occurrence(since: Column) -> Column:
    """First day on or after `since` on which the task falls, in closed form; null when none."""
    period = F.when(_freq() == "weekly", 7).otherwise(14)
    has_wd = F.col("weekday").isNotNull()
    base = F.when(has_wd, F.coalesce("start_on", "anchor_date")).otherwise(F.col("anchor_date"))
    usable = ~has_wd | (F.weekday(base) == F.col("weekday"))

    def regular(day: Column) -> Column:
        steps = F.greatest(F.ceil(F.date_diff(day, base) / period), F.lit(0))
        stepped = F.when(usable, F.date_add(base, (steps * period).cast("int")))
        return (
            F.when(_freq() == "one-off", F.when(F.col("due") >= day, F.col("due")))
            .when(_freq() == "monthly", next_monthly(day, _or("dom", 1)))
            .when(_freq() == "semi-monthly", next_semi_monthly(day, _or("dom", 5), _or("dom2", 20)))
            .when(_freq().isin("weekly", "biweekly"), stepped)
            .when(_freq() == "quarterly", next_quarterly(day, _months(), _or("dom", 15)))
        )

    low = F.greatest(since, F.col("effective_from"), F.col("start_on"))
    first = regular(low)
    skipped = (F.col("pause_from") < F.col("resume_from")) & (first >= F.col("pause_from")) & (first < F.col("resume_from"))
    day = F.when(skipped, regular(F.greatest(low, F.col("resume_from")))).otherwise(first)
    over = (day > F.col("end_on")) | (F.col("is_paused") & (day >= F.col("pause_from")))
    return F.when(~F.coalesce(over, F.lit(False)), day)


def pause_start(today: dt.date) -> Column:
    """Where a pause should begin: the next occurrence after the last closed one."""
    t = F.lit(today)
    none = F.array().cast("array<date>")
    closed = F.array_max(
        F.filter(F.concat(F.coalesce("completed", none), F.coalesce("cancelled", none)), lambda d: d <= t)
    )
    since = F.coalesce(F.date_add(closed, 1), F.col("start_on"), t)
    day = next_occurrence(since)
    return F.when(_freq() != "one-off", day)


def _nearest(occ: DataFrame, key: str, past: Column, ahead: Column, skip_done: bool) -> DataFrame:
    """The occurrences of `past`, and of those of `ahead` a task's first and the next one not done.

    With `skip_done` the second is shown only where the first is done.  Occurrences per task in a
    feed window number a few dozen at most; one shuffle by task serves all ranks.
    """
    flagged = occ.withColumns({"__past": F.coalesce(past, F.lit(False)), "__up": F.coalesce(ahead, F.lit(False))})
    line = Window.partitionBy(key, "__up").orderBy("disp", "orig")
    ranked = flagged.withColumns({"__no": F.row_number().over(line), "__done": F.first("is_done").over(line)})
    waits = (F.col("__no") > 1) & ~F.col("is_done")
    ranked = ranked.withColumn("__wait", F.sum(F.when(waits, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    second = waits & (F.col("__wait") == 1) & (F.col("__done") if skip_done else F.lit(True))
    kept = ranked.filter(F.col("__past") | (F.col("__up") & ((F.col("__no") == 1) | second)))
    return kept.drop("__past", "__up", "__no", "__done", "__wait")


def next_occurrences(occ: DataFrame, today: dt.date, end: dt.date, key: str = "id") -> DataFrame:
    """Per task the nearest upcoming occurrence, and the next one not yet done."""
    return _nearest(occ, key, F.lit(False), F.col("disp").between(F.lit(today), F.lit(end)), skip_done=False)


def _first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; groups are the copies of one task's occurrence, already side by side."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("__at = 1").drop("__at")


def todo_feed(
    tasks: DataFrame, today: dt.date, past_days: int = PAST_DAYS, future_days: int = FUTURE_DAYS
) -> DataFrame:
    """Dashboard feed: past window rows plus nearest upcoming rows, with mark and tags."""
    t, one = F.lit(today), dt.timedelta(days=1)
    start, end = today - dt.timedelta(days=past_days), today + dt.timedelta(days=future_days)
    enabled = tasks.filter(F.coalesce("is_enabled", F.lit(True))).withColumn("kind_label", kind_label())
    occ = expand_occurrences(enabled, start, end)
    past = (F.col("orig") <= F.date_add(F.lit(today - one), 10)) & F.col("disp").between(F.lit(start), F.lit(end))
    ahead = (F.col("orig") >= F.date_sub(t, 10)) & F.col("disp").between(t, F.lit(end))
    rows = _first_of(_nearest(occ, "id", past, ahead, skip_done=False), ["id", "orig"], "disp")
    mark = F.when(F.col("is_cancelled"), "×").when(F.col("is_done"), "v").otherwise("ㅁ")
    closed = F.col("is_done") | F.col("is_cancelled")
    tags = occurrence_tags(F.col("disp"), closed, t, F.col("method"), F.col("action_lead_days"))
    tags = F.when(F.col("is_cancelled"), F.concat(tags, F.array(F.lit("cancelled")))).otherwise(tags)
    return rows.withColumn("mark", mark).withColumn("tags", tags)


def client_task_feed(
    tasks: DataFrame, today: dt.date, past_days: int = 7, future_days: int = 14, key: str = "id"
) -> DataFrame:
    """Profile feed: done by original date only, a single upcoming row unless it is done."""
    start, end = today - dt.timedelta(days=past_days), today + dt.timedelta(days=future_days)
    occ = expand_occurrences(tasks.withColumn("kind_label", kind_label()), start, end, buffer=5, done_by="orig")
    past = (F.col("orig") <= F.lit(today + dt.timedelta(days=4))) & (F.col("disp") >= F.lit(start)) & (F.col("disp") < F.lit(today))
    ahead = (F.col("orig") >= F.lit(today - dt.timedelta(days=5))) & F.col("disp").between(F.lit(today), F.lit(end))
    return _first_of(_nearest(occ, key, past, ahead, skip_done=True), [key, "disp"], "orig")


def sort_todo(feed: DataFrame, key: str = "date", ascending: bool = False) -> DataFrame:
    """Feed order: by date (undone, then submissions, then names) or by kind or client."""
    client, kind = F.lower(blank("client_name")), F.lower(blank("kind_label"))
    if key == "date":
        submits = ~F.col("is_done") & (
            F.lower(blank("method")).isin(*SUBMISSION_METHODS) | (_or("action_lead_days", 0) > 0)
        )
        day = F.col("disp").asc() if ascending else F.col("disp").desc()
        return feed.orderBy(day, F.col("is_done").asc(), submits.desc(), client, kind, "id", "orig")
    names = [kind, client] if key == "kind" else [client, kind]
    cols = [*names, F.col("disp"), F.col("id"), F.col("orig")]
    return feed.orderBy(*[c.asc() if ascending else c.desc() for c in cols])


def calendar_month(tasks: DataFrame, year: int, month: int, skip_disabled: bool = True) -> DataFrame:
    """Occurrences displayed in a month, scanned from its first day to three days past its last."""
    first = dt.date(year, month, 1)
    last = (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    if skip_disabled:
        tasks = tasks.filter(F.coalesce("is_enabled", F.lit(True)))
    occ = expand_occurrences(tasks, first, last + dt.timedelta(days=3))
    state = F.when(F.col("is_cancelled"), "cancelled").when(F.col("is_done"), "done").otherwise("todo")
    return occ.filter(F.col("disp").between(F.lit(first), F.lit(last))).withColumn("state", state)


def calendar_badges(month_rows: DataFrame) -> DataFrame:
    """Per display day: open and closed counts."""
    return month_rows.groupBy("disp").agg(
        F.count_if(F.col("state") == "todo").alias("todo"), F.count_if(F.col("state") != "todo").alias("closed")
    )


def _recurring_open() -> Column:
    return (_freq() != "one-off") & F.col("end_on").isNull()


def _of_clients(tasks: DataFrame, clients: DataFrame) -> DataFrame:
    """Tasks matched by position or by name: two semi-joins over one key column, never an OR."""
    keys = clients.select(
        F.explode(
            F.array(F.concat(F.lit("i:"), F.col("client_idx").cast("string")), F.concat(F.lit("n:"), F.lower(blank("name"))))
        ).alias("__k")
    ).filter(F.col("__k").isNotNull() & (F.col("__k") != "n:")).distinct()
    mine = tasks.select(
        "id",
        F.explode(
            F.array(
                F.concat(F.lit("i:"), F.col("client_idx").cast("string")), F.concat(F.lit("n:"), F.lower(blank("client_name")))
            )
        ).alias("__k"),
    )
    return mine.join(keys, "__k", "left_semi").select("id").distinct()


def batch_pause(tasks: DataFrame, clients: DataFrame, today: dt.date) -> DataFrame:
    """Pause every active recurring task of the clients; adds `changed`."""
    hit = _of_clients(tasks, clients).withColumn("__hit", F.lit(True))
    go = F.col("__hit").isNotNull() & _recurring_open() & F.coalesce("is_enabled", F.lit(True)) & ~F.coalesce("is_paused", F.lit(False))
    out = tasks.join(hit, "id", "left").withColumn("changed", go).withColumn("__from", F.coalesce(pause_start(today), F.lit(today)))
    return (
        out.withColumn("pause_from", F.when(F.col("changed"), F.col("__from")).otherwise(F.col("pause_from")))
        .withColumn("resume_from", F.when(~F.col("changed"), F.col("resume_from")))
        .withColumn("is_paused", F.col("changed") | F.coalesce("is_paused", F.lit(False)))
        .drop("__hit", "__from")
    )


def batch_resume(tasks: DataFrame, clients: DataFrame, today: dt.date) -> DataFrame:
    """Resume every paused recurring task of the clients; adds `changed`."""
    hit = _of_clients(tasks, clients).withColumn("__hit", F.lit(True))
    go = F.col("__hit").isNotNull() & _recurring_open() & F.coalesce("is_paused", F.lit(False))
    out = tasks.join(hit, "id", "left").withColumn("changed", go)
    return (
        out.withColumn("resume_from", F.when(F.col("changed"), F.lit(today)).otherwise(F.col("resume_from")))
        .withColumn("is_paused", F.when(F.col("changed"), False).otherwise(F.col("is_paused")))
        .drop("__hit")
    )


def split_series(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (id, effective_from, new task columns in struct `new`) without touching the past.

    A one-off, a missing date, or a date not after the start replaces the task; otherwise
    the old series ends the day before and a new one starts clean with id `new_id`.
    """
    cols = [c for c in tasks.columns]
    e = edits.select("id", F.col("effective_from").alias("__from"), F.col("new").alias("__new"), F.col("new_id").alias("__id"))
    out = tasks.join(e, "id", "left")
    start = F.coalesce("start_on", "due")
    replace = (_freq() == "one-off") | F.col("__from").isNull() | (start.isNotNull() & (F.col("__from") <= start))
    types = dict(tasks.dtypes)
    fields = {f.name for f in edits.schema["new"].dataType.fields}
    same = F.struct(*[F.col(c).alias(c) for c in cols])
    swapped = F.struct(*[(F.col("__new")[c] if c in fields else F.col(c)).cast(types[c]).alias(c) for c in cols])
    before = F.struct(
        *[
            {"end_on": F.date_sub("__from", 1), "is_enabled": F.lit(True)}.get(c, F.col(c)).cast(types[c]).alias(c)
            for c in cols
        ]
    )
    given = lambda c: F.col("__new")[c] if c in fields else F.col(c)
    none = F.array().cast("array<date>")
    fresh = {
        "id": F.col("__id"),
        "effective_from": F.col("__from"),
        "start_on": F.greatest(given("start_on"), F.col("__from")),
        "end_on": F.when(given("end_on") >= F.col("__from"), given("end_on")),
        "completed": none,
        "cancelled": none,
        "is_paused": F.lit(False),
        "pause_from": F.lit(None),
        "resume_from": F.lit(None),
    }
    after = F.struct(*[fresh.get(c, given(c)).cast(types[c]).alias(c) for c in cols])
    rows = F.when(F.col("__new").isNull(), F.array(same)).when(replace, F.array(swapped)).otherwise(F.array(before, after))
    return out.select(F.explode(rows).alias("t")).select("t.*")


def set_occurrence_state(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply (id, orig, state) with state todo | done | cancel | toggle_done | toggle_cancel.

    One edit per (task, day); days of a task are applied together because they touch
    different dates.  Both arrays stay disjoint over original and display dates.
    """
    none = F.array().cast("array<date>")
    lead = tasks.select("id", "action_lead_days", "completed", "cancelled")
    day = display_date(edits.join(lead, "id"), "orig", "action_lead_days", "disp")
    both = F.array_distinct(F.array("orig", "disp"))
    in_bag = lambda c: F.arrays_overlap(F.coalesce(F.col(c), none), F.array("orig", "disp"))
    state = (
        F.when(F.col("state") == "toggle_done", F.when(in_bag("completed"), "undone").otherwise("only_done"))
        .when(F.col("state") == "toggle_cancel", F.when(in_bag("cancelled"), "uncancel").otherwise("cancel"))
        .otherwise(F.col("state"))
    )
    day = day.withColumn("__state", state).withColumn("__both", both)
    gather = lambda *states: F.flatten(F.collect_list(F.when(F.col("__state").isin(*states), F.col("__both"))))
    per_task = day.groupBy("id").agg(
        gather("todo", "undone", "cancel", "done").alias("__off_done"),
        gather("todo", "uncancel", "done", "cancel").alias("__off_canc"),
        gather("done", "only_done").alias("__on_done"),
        gather("cancel").alias("__on_canc"),
    )
    out = tasks.join(per_task, "id", "left")

    def bag(col: str, off: str, on: str) -> Column:
        now = F.coalesce(F.col(col), none)
        changed = F.array_union(F.array_except(now, F.coalesce(F.col(off), none)), F.coalesce(F.col(on), none))
        return F.when(F.col(off).isNull(), now).otherwise(changed)

    return out.withColumns(
        {"completed": bag("completed", "__off_done", "__on_done"), "cancelled": bag("cancelled", "__off_canc", "__on_canc")}
    ).drop("__off_done", "__off_canc", "__on_done", "__on_canc")


def default_anchor(freq: Column, today: dt.date) -> Column:
    """Where a new series starts: this Monday, the first of the month, or today."""
    t = F.lit(today)
    return (
        F.when(freq.isin("weekly", "biweekly"), F.date_trunc("week", t).cast("date"))
        .when(freq.isin("monthly", "semi-monthly", "quarterly"), F.trunc(t, "month"))
        .otherwise(t)
    )


def task_overview(tasks: DataFrame, today: dt.date, legacy: bool = False) -> DataFrame:
    """One row per series: schedule label, state and due or next date.

    `legacy` takes the first date after the start instead of after today for monthly kinds.
    """
    t = F.lit(today)
    start = F.coalesce("start_on", t)
    since = start if legacy else F.greatest(start, t)
    regular = (
        F.when(_freq() == "monthly", next_monthly(since, _or("dom", 5)))
        .when(_freq() == "semi-monthly", next_semi_monthly(since, _or("dom", 5), _or("dom2", 20)))
        .when(_freq() == "quarterly", next_quarterly(since, _months(), _or("dom", 15)))
        .when(_freq().isin("weekly", "biweekly"), next_occurrence(t))
    )
    stopped = F.coalesce(F.col("end_on") < t, F.lit(False))
    due = F.when(_freq() == "one-off", F.col("due")).when(~stopped, F.coalesce(regular, F.col("due")))
    rows = tasks.withColumn("next_due", due).withColumn("__stopped", stopped)
    rows = display_date(rows, "next_due", "action_lead_days", "__disp")
    none = F.array().cast("array<date>")
    held = lambda c: F.coalesce(F.arrays_overlap(F.coalesce(F.col(c), none), F.array("next_due", "__disp")), F.lit(False))
    late = F.coalesce(F.col("next_due") < t, F.lit(False))
    state = (
        F.when(F.col("__stopped"), "Stopped")
        .when(F.coalesce("is_paused", F.lit(False)), "Paused")
        .when(~late, "In progress")
        .when(held("completed"), "Done")
        .when(held("cancelled"), "Canceled")
        .otherwise("Past due")
    )
    label = F.when(_freq() == "one-off", "One-off").otherwise(F.concat(F.lit("Recurring ("), _freq(), F.lit(")")))
    return rows.select(
        "id", kind_label().alias("kind_label"), label.alias("schedule"), state.alias("state"),
        F.coalesce(F.col("next_due").cast("string"), F.lit("—")).alias("due_or_next"),
    )
