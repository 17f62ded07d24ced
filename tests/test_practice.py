"""Sequential definitions of merges, sessions, names, and round trips through files."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import calendar as cal
from ledgerloom.operators import documents as dc
from ledgerloom.operators import graph as gr
from ledgerloom.operators import merges as mg
from ledgerloom.operators import replay as rp
from ledgerloom.operators import tasks as tk
from ledgerloom.operators import worklog as wl
from ledgerloom.sources import readers, sinks, versions


def test_merge_clients_equals_first_wins_loop(spark):
    rng = random.Random(8)
    pick = lambda n: str(rng.randint(1, n)) if rng.random() < 0.8 else ""
    rows = [(i, pick(60), pick(60), rng.choice(["LLC", "individual"])) for i in range(120)]
    cur = [(0, "1", "2", "LLC"), (1, "", "3", "individual")]
    schema = "row_no int, id string, ein string, entity_type string"

    def keys(r):
        out = {("id", r[1])} if r[1] else set()
        if r[2]:
            out.add(("ssn" if r[3] == "individual" else "ein", r[2]))
        return out

    seen, want = set().union(*[keys(r) for r in cur]), {}
    for r in rows:
        want[r[0]] = "skipped" if keys(r) & seen else "added"
        if want[r[0]] == "added":
            seen |= keys(r)
    out = mg.merge_clients(spark.createDataFrame(cur, schema), spark.createDataFrame(rows, schema))
    assert {r.row_no: r.outcome for r in out.collect()} == want
    added = out.filter("outcome = 'added'").drop("outcome")
    again = mg.merge_clients(spark.createDataFrame(cur, schema).unionByName(added), spark.createDataFrame(rows, schema)).filter("outcome = 'added' AND (id <> '' OR ein <> '')")
    assert again.count() == 0


def test_a_long_chain_of_clients_takes_few_rounds(spark, monkeypatch):
    """Each row shares its id with the row before it or its EIN, in turns."""
    n, writes = 10_000, []
    rows = [(i, str((i + 1) // 2 + 1), f"{i // 2 + 1:09d}", "LLC") for i in range(n)]
    real = mg.cut_lineage
    monkeypatch.setattr(mg, "cut_lineage", lambda df: writes.append(1) or real(df))
    schema = "row_no int, id string, ein string, entity_type string"
    seen, want = set(), {}
    for i, a, b, _ in rows:
        mine = {("id", a), ("ein", b)}
        want[i] = "skipped" if mine & seen else "added"
        seen |= mine if want[i] == "added" else set()
    out = mg.merge_clients(spark.createDataFrame(rows[:0], schema), spark.createDataFrame(rows, schema))
    assert {r.row_no: r.outcome for r in out.collect()} == want
    assert len(writes) <= 25


def _events(rng, n):
    t0 = dt.datetime(2024, 1, 1)
    return [
        (rng.randint(0, 4), i, t0 + dt.timedelta(minutes=i), rng.choice(wl.ACTIONS), f"Task {rng.randint(0, 2)}", rng.choice(["", f"n{i}"]))
        for i in range(n)
    ]


EVENTS = "client_idx long, seq long, ts timestamp, action string, task_name string, note string"


def _verdicts(rows):
    """Allowed events by walking every client in order."""
    seen, out = {}, set()
    for c, seq, _, action, task, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        active, known = seen.setdefault(c, [None, {}])
        step = rp.next_status(action, task.strip().lower(), active, known)
        if step:
            out.add((c, seq, step[0], known.get(step[0]), step[1]))
            known[step[0]] = step[1]
            seen[c][0] = step[0] if step[1] == "active" else None if step[0] == active else active
    return out


def test_what_is_left_of_a_run_does_what_the_run_does():
    """Residual programs against the events themselves, from every kind of register, and their length."""
    rng = random.Random(5)
    for _ in range(3000):
        many = rng.choice([1, 2, 3, 6])
        event = lambda: (rng.choice(rp.ACTIONS), rng.choice(["", *(f"t{i}" for i in range(many))]))
        start, run = [event() for _ in range(rng.choice([0, 3, 20]))], [event() for _ in range(rng.choice([1, 2, 5, 40]))]
        plain, short, left = rp.Register(), rp.Register(), rp.Residue()
        for e in start:
            plain.take(*e)
            short.take(*e)
        for e in run:
            plain.take(*e)
            left.take(*e)
        rp.run_program(short, left.program())
        assert (plain.active, plain.known) == (short.active, short.known), (start, run)
    left = rp.Residue()
    for _ in range(10_000):
        left.take(rng.choice(rp.ACTIONS), f"t{rng.randrange(5)}")
    assert len(left.program()) < 200


def test_replay_does_not_depend_on_the_ranges(spark):
    """A client with a third of all rows, cut into many ranges, among small ones."""
    rng = random.Random(6)
    rows = _events(rng, 400)
    rows += [(9, 10_000 + i, dt.datetime(2024, 3, 1), rng.choice(wl.ACTIONS), f"Task {rng.randint(0, 40)}", "") for i in range(200)]
    df = spark.createDataFrame(rows, EVENTS)
    base = df.withColumn("task", F.lower("task_name"))
    for slices in (1, 7, 60):
        got = {(r.client_idx, r.seq, r.item, r.status, r.to) for r in rp.judge_events(base, slices).collect()}
        assert got == _verdicts(rows)
    for x, y in zip(wl.replay_work_events(df, 1), wl.replay_work_events(df, 25), strict=True):
        left = sorted(map(str, x.select(*sorted(x.columns)).collect()))
        assert left and left == sorted(map(str, y.select(*sorted(y.columns)).collect()))
    assert rp.judge_events(base.limit(0)).count() == 0


def test_stream_equals_the_batch_with_holds(spark, tmp_path):
    """Two batches out of order, sessions that time out in the middle and at the end, and a client that is forgotten."""
    from ledgerloom.streaming.work_sessions import AUTO_HELD, use_rocksdb, with_auto_holds, work_sessions_stream

    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows, at = [], t0
    for i in range(240):
        at += dt.timedelta(minutes=rng.choice([0, 1, 20, 90]))
        rows.append((rng.randint(0, 4), i, at, rng.choice(wl.ACTIONS), f"Task {rng.randint(0, 2)}", rng.choice(["", f"n{i}"])))
    far = at + dt.timedelta(days=40)
    rows += [(7, 900, t0, "start", "Once", ""), (7, 901, far, "resume", "Once", ""), (8, 902, far + dt.timedelta(hours=9), "start", "Late", "")]
    df = spark.createDataFrame(rows, EVENTS)
    rng.shuffle(rows)
    spark.createDataFrame(rows, EVENTS).repartition(6).write.parquet(str(tmp_path / "in"))
    use_rocksdb(spark)
    out = work_sessions_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in")), timeout="1 hour", forget="30 days")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    end = far + dt.timedelta(hours=9) - dt.timedelta(minutes=10)
    base = with_auto_holds(df, "1 hour").withColumn("task", F.lower("task_name"))
    verdicts = rp.judge_events(base.filter(F.col("ts") <= F.lit(end)), 5)
    want = {(r.client_idx, r.seq.of, r.ts, r.item, r.to, r.note or "") for r in verdicts.collect()}
    # the batch form remembers for ever; the stream has forgotten client 7 when it comes back
    want = {w for w in want if w[0] != 7 or w[2] < far}
    assert got == want
    assert sum(r[5] == AUTO_HELD for r in got) > 10 and (7, 900, t0 + dt.timedelta(hours=1), "once", "on_hold", AUTO_HELD) in got


def test_unique_names_equal_the_loop(spark):
    rng = random.Random(12)
    pool = ["a.txt", "A.txt", "a (1).txt", "a (2).txt", "b", "b (1)", "a (1) (1).txt"]
    files = [("d", rng.choice(pool), i) for i in range(40)]
    used, want = {"a (3).txt", "b"}, {}
    for _, name, i in files:
        stem, dot, ext = name.rpartition(".")
        base, tail = (stem, dot + ext) if stem else (name, "")
        n, cand = 0, name
        while cand.lower() in used:
            n += 1
            cand = f"{base} ({n}){tail}"
        used.add(cand.lower())
        want[i] = cand
    f = spark.createDataFrame(files, "folder string, name string, ord long")
    e = spark.createDataFrame([("d", "a (3).txt"), ("d", "B")], "folder string, name string")
    assert {r.ord: r.unique_name for r in dc.unique_names(f, e).collect()} == want


def test_back_links_then_nothing_more(spark):
    nodes = spark.createDataFrame([(i, f"N{i}", "LLC", str(i + 1)) for i in range(6)], "client_idx long, name string, entity_type string, ein string")
    blank = {c: F.lit("") for c in gr.ATTRIBUTES}
    raw = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 3, 0), (4, 4, 0), (5, None, 0)], "src long, dst long, pos int")
    e = raw.select("*", F.lit("owner").alias("role"), F.lit("k").alias("id"), *[v.alias(k) for k, v in blank.items()])
    full = gr.add_missing_back_links(e, nodes)
    assert {(r.src, r.dst, r.role) for r in full.collect()} - {(r.src, r.dst, r.role) for r in e.collect()} == {(3, 2, "business")}
    assert gr.add_missing_back_links(full, nodes).count() == full.count()
    assert {(r.src, r.dst) for r in gr.drop_one_way_links(e, nodes).collect()} == {(0, 1), (1, 0), (4, 4), (5, None)}
    keyless = nodes.withColumn("ein", F.when(F.col("client_idx") == 2, "").otherwise(F.col("ein")))
    assert (2, 3) in {(r.src, r.dst) for r in gr.drop_one_way_links(e, keyless).collect()}


def test_client_positions_run_over_files(spark, tmp_path):
    for f, names in {"c": ["E", "F"], "a": ["A", "B"], "b": ["C", "D"]}.items():
        (tmp_path / f"{f}.json").write_text(json.dumps([{"name": n} for n in names]))
    rows = readers.read_clients(spark, str(tmp_path)).select("client_idx", "name").collect()
    assert sorted((r.client_idx, r.name) for r in rows) == list(enumerate("ABCDEF"))


def test_book_written_over_its_own_source(spark, tmp_path):
    path = str(tmp_path / "book")
    (tmp_path / "first.json").write_text(json.dumps([{"name": "A", "ein": "1"}, {"name": "B", "ein": "2"}]))
    sinks.write_clients(readers.read_clients(spark, str(tmp_path / "first.json")), path)
    again = spark.read.schema(readers.schemas.CLIENTS).json(path)
    kept = readers.normalize_clients(again.withColumn("client_idx", F.monotonically_increasing_id()))
    assert sinks.write_clients(kept, path)["clients"] == 2


def test_a_failed_commit_leaves_the_book_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "book")
    with pytest.raises(FileNotFoundError):
        sinks.read_book(spark, path)
    (tmp_path / "c.json").write_text(json.dumps([{"name": "A", "ein": "1"}, {"name": "B", "ein": "2"}]))
    c = readers.read_clients(spark, str(tmp_path / "c.json"))
    assert sinks.write_clients(c, path) == {"clients": 2, "relations": 0}
    monkeypatch.setattr(versions, "read_counts", lambda df, counts: {"clients": 1, "relations": 0})
    with pytest.raises(OSError):
        sinks.write_clients(c.filter("name = 'A'").unionByName(c), path)
    assert sorted((r.client_idx, r.name) for r in sinks.read_book(spark, path).collect()) == [(0, "A"), (1, "B")]
    monkeypatch.undo()
    assert sinks.write_clients(c.limit(0), path) == {"clients": 0, "relations": 0}
    assert sinks.read_book(spark, path).count() == 0


def test_shifts_far_away_and_long_leads(spark):
    days = [dt.date(1950, 1, 1), dt.date(1998, 7, 4), dt.date(2099, 12, 31)]
    rows = [(d, n) for d in days for n in (0, 1, -1, 5, 120, -120, 400)]

    def is_open(d):
        got = spark_holidays[d.year]
        return d.weekday() < 5 and d not in got

    spark_holidays = {y: us_holidays(y) for y in range(1940, 2110)}

    def walk(d, n):
        while n:
            d += dt.timedelta(days=1 if n > 0 else -1)
            n -= (1 if n > 0 else -1) if is_open(d) else 0
        return d

    df = spark.createDataFrame(rows, "day date, n int")
    got = {(r.day, r.n): r.to for r in cal.shift_business_days(df, "day", "n", "to").collect()}
    assert got == {(d, n): walk(d, n) for d, n in rows}
    shown = {(r.day, r.n): r.to for r in cal.display_date(df, "day", "n", "to").collect()}

    def rolled(d):
        while not is_open(d):
            d -= dt.timedelta(days=1)
        return d

    assert shown == {(d, n): walk(rolled(d), -max(n, 0)) for d, n in rows}


def us_holidays(y):
    def nth(m, wd, n):
        first = dt.date(y, m, 1)
        return first + dt.timedelta(days=(wd - first.weekday()) % 7 + 7 * (n - 1))

    last_monday = max(dt.date(y, 5, k) for k in range(25, 32) if dt.date(y, 5, k).weekday() == 0)
    fixed = [dt.date(y, m, d) for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))]
    return {*fixed, nth(1, 0, 3), nth(2, 0, 3), last_monday, nth(9, 0, 1), nth(10, 0, 2), nth(11, 3, 4)}


def test_client_files_round_trip(spark, tmp_path):
    book = [
        {"id": "x", "name": "Acme", "entity_type": "LLC", "ein": "12-3456789", "owner": "Old Owner"},
        {"name": "Jo Li", "entity_type": "Individual", "ssn": "111-22-3333", "relations": [{"id": "ein:123456789", "role": "business"}], "officers": [{"name": "P", "email": "p@x"}]},
    ]
    (tmp_path / "clients.json").write_text(json.dumps(book))
    c = readers.read_clients(spark, str(tmp_path / "clients.json"))
    rows = {r["name"]: r for r in c.collect()}
    assert [p["first_name"] for p in rows["Acme"]["relations"]] == ["Old Owner"]
    assert [p["role"] for p in rows["Jo Li"]["relations"]] == ["business", "officer"]
    grown = gr.add_missing_back_links(gr.explode_edges(c), c)
    merged = c.drop("relations").join(gr.edges_to_relations(grown), "client_idx", "left")
    assert sinks.write_clients(merged, str(tmp_path / "out")) == {"clients": 2, "relations": 4}
    assert sinks.write_clients(c, str(tmp_path / "lone")) == {"clients": 2, "relations": 2}
    sinks.export_bundle({"clients": c}, str(tmp_path / "b"), {"clients": True, "include_logs": False})
    tables, counts = sinks.import_bundle(spark, str(tmp_path / "b"), {"clients": c.limit(0)})
    assert counts["clients_added"] == 2 and tables["clients"].count() == 2


def test_enumerated_days_are_those_the_predicate_accepts(spark):
    """Every rule, odd days of month, missing columns, pauses and gaps, on windows long and short."""
    rng = random.Random(3)
    day = lambda: rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(500))])
    freqs = ["monthly", "semi-monthly", "weekly", "biweekly", "quarterly", "one-off", "", None, "Weekly", "yearly"]
    rows = [
        (i, rng.choice(freqs), rng.choice([None, 0, 1, 15, 29, 31, 40]), rng.choice([None, 0, 20, 31]), rng.choice([None, *range(7)]), day(), rng.choice([None, [], [2, 5, 11]]), day(), day(), day(), day(), day(),
         rng.choice([None, True, False]), day(), rng.choice([0, 2]))
        for i in range(800)
    ]
    schema = "id int, freq string, dom int, dom2 int, weekday int, anchor_date date, months array<int>, start_on date, effective_from date, end_on date, pause_from date, resume_from date, is_paused boolean, due date, action_lead_days int"
    t = spark.createDataFrame(rows, schema)
    for lo, hi in ((dt.date(2024, 1, 1), dt.date(2025, 12, 31)), (dt.date(2024, 2, 28), dt.date(2024, 3, 2)), (dt.date(2024, 5, 5), dt.date(2024, 5, 4))):
        got = sorted((r.id, r.orig) for r in tk._enumerated(t, lo, hi).select("id", "orig").collect())
        days = F.sequence(F.lit(lo), F.lit(hi)) if lo <= hi else F.array().cast("array<date>")
        want = sorted((r.id, r.d) for r in t.select("id", F.explode(F.filter(days, tk.occurs_on)).alias("d")).collect())
        assert got == want and (lo > hi or want)


def test_small_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"phrase": " a ", "vendor": "V"}, {"phrase": "", "vendor": "W"}]))
    assert [(r.phrase, r.vendor) for r in readers.read_rules(spark, str(tmp_path / "r.json")).collect()] == [("a", "V")]
    (tmp_path / "a.json").write_text(json.dumps({"V|x|debits": "1", "W": "2"}))
    got = {(r.vendor, r.direction, r.account) for r in readers.read_accounts(spark, str(tmp_path / "a.json")).collect()}
    assert got == {("V|x", "debits", "1"), ("W", "debits", "2"), ("W", "credits", "2")}
    (tmp_path / "c.json").write_text(json.dumps({"companies": ["b ", "a", "b"]}))
    assert [r.company for r in readers.read_companies(spark, str(tmp_path / "c.json")).collect()] == ["a", "b"]
    (tmp_path / "m.json").write_text(json.dumps(["Ann", {"name": "ANN", "email": "", "phone": ""}, {"name": "Bo", "phone": "1"}]))
    assert sorted(r.name for r in readers.read_managers(spark, str(tmp_path / "m.json")).collect()) == ["Ann", "Bo"]
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "kind": "tax", "client_name": "Acme", "recurrence": {"freq": "monthly", "dom": 31}, "start_on": "2024-01-31", "completed": ["2024-02-29", "x"]}]))
    t = readers.read_tasks(spark, str(tmp_path / "t.json"))
    occ = tk.expand_occurrences(t, dt.date(2024, 2, 15), dt.date(2024, 3, 31), buffer=0)
    assert [(r.orig, r.disp, r.is_done) for r in occ.orderBy("orig").collect()] == [
        (dt.date(2024, 2, 29), dt.date(2024, 2, 29), True), (dt.date(2024, 3, 31), dt.date(2024, 3, 29), False)
    ]
    grid = {"tax": {"years": {"2024": {"companies": ["k"], "cells": {"k": {"Jan": "Done ✅", "Feb": "odd"}}}}}}
    (tmp_path / "g.json").write_text(json.dumps(grid))
    cells = {r.col: r.value for r in readers.read_checklist(spark, str(tmp_path / "g.json")).collect()}
    assert len(cells) == 16 and cells["Jan"] == "Done" and cells["Feb"] == ""
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "u.csv").write_bytes("Vendor,Note\nCafé,1\n".encode())
    (tmp_path / "csv" / "l.csv").write_bytes("Vendor,Note\nNiño,2\n".encode("latin-1"))
    assert sorted(r.Vendor for r in readers.read_delimited(spark, str(tmp_path / "csv")).collect()) == ["Café", "Niño"]


def test_wage_records_of_any_length(spark):
    from ledgerloom.operators import wages as wg

    names = ["ALPHA", "BETA", "GAMMA", "DELTA", "EPSILON", "ZETA", "ETA", "THETA"]
    ca = ["123456789", *names, "1,000.00", "900.00", "10.00"]
    ny = ["111-22-3333", "DOE", "JANE", *["O"] * 60, "K", "700,000.00", "2.00"]
    table = lambda x: spark.createDataFrame([("d", i, t) for i, t in enumerate(x)], "doc_id string, pos long, text string")
    assert wg.california_rows(table(ca)).first()["name_line"] == " ".join(names)
    rows = wg.new_york_rows(table(ny))
    assert [(r.last_name, r.first_name, float(r.amount_1)) for r in rows.collect()] == [("Doe", "Jane", 700000.0)]
    kept, dropped = wg.filter_wage_rows(rows)
    assert kept.count() == 0 and [(r.reason, r.n) for r in dropped.collect()] == [("implausible", 1)]


def test_payroll_lines_are_read_in_one_pass(spark):
    """Notes of any section of a name, memos that come twice, odd white space, lines of no document."""
    from ledgerloom.operators import payroll as pr

    texts = [
        "Old 5 5", "ANN  LEE", "1,500", "보고 1", "kitchen", "12 3.5 1 0 5 2.25 $1,200.5 tips sick 1.5", "0 9", "PAY\tDATE 3", "보고 2", "9 1 extra $x 7", "BOB", "Server", "보너스 100",
        "Ann Lee", "SUSHI  BAR", "50 빼고", "ANN LEE", "2,000", "Server", " 12.345 8", "빌려간돈 1,000 $", "보고 1", "kitchen", "20 4 SICK2",
    ]
    lines = spark.createDataFrame([(d, i, t) for d in ("a", None) for i, t in enumerate(texts)], "doc_id string, pos bigint, text string")
    out = pr.payroll_by_section(lines)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    names = ("rate", "reg", "over", "double", "tip", "advance", "bonus", "sick", "salary")
    got = {(r.doc_id, r["name"], r.section): (*[float(r[c]) for c in names], r.memo) for r in out.collect()}
    want = {
        ("ANN LEE", "KITCHEN"): (12, 17.5, 1, 0, 1200.5, -7.25, 0, 3.5, 2000, "보고 1"),
        ("ANN LEE", "SERVER"): (0, 0, 0, 0, 0, -1000, 0, 0, 2000, "보고 1"),
        ("BOB", "SERVER"): (0, 0, 0, 0, 0, 0, 100, 0, 0, ""),
        ("Ann Lee", "SUSHI BAR"): (50, 0, 0, 0, 0, -50, 0, 0, 0, ""),
    }
    assert got == {("a", *k): v for k, v in want.items()} | {(None, *k): (*v[:8], 0, "") for k, v in want.items()}


def test_new_york_lines_are_read_from_their_source_once(spark, monkeypatch):
    """A document per layout, one that California's layout reads, and lines of no document."""
    from ledgerloom.operators import wages as wg

    docs = {
        "a": ["111-22-3333", "DOE", "JANE", "O", "K", "5.00", "1.00", "9.00"],
        "b": ["111-22-3333", "DOE, JANE K", "5.00", "1.00", "9.00", "7.00", "222-33-4444", "ROE, BOB", "3.00"],
        "c": ["DOE", "JANE", "4.00", "Part C wage reporting", "DOE", "JANE", "K", "5.00", "1.00", "ROE", "BOB", "6.00", "2.00", "222-33-4444"],
        "d": ["111223333 JANE K", "DOE", "9.00", "5.00", "1.00"],
        None: ["111-22-3333", "DOE", "JANE", "O", "5.00", "1.00", "222-33-4444", "ROE, BOB", "6.00", "2.00"],
    }
    lines = spark.createDataFrame([(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)], "doc_id string, pos long, text string")
    plans, write = [], wg.cut_lineage
    monkeypatch.setattr(wg, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    out = wg.wage_rows(lines, "NY")
    assert sum("LogicalRDD" in p for p in plans) == 1
    got = {(r.doc_id, r.row_no): (r.ssn, r.first_name, r.middle_initial, r.last_name, float(r.amount_1), float(r.amount_3)) for r in out.collect() if r.plan_code is None or r.doc_id}
    assert got == {
        ("a", 0): ("111-22-3333", "Jane", "K", "Doe", 5, 9),
        ("b", 0): ("111-22-3333", "Jane", "K", "Doe", 5, 9),
        ("c", 4): ("222-33-4444", "Jane", "K", "Doe", 5, 0),
        ("c", 9): ("000000000", "Bob", "", "Roe", 6, 0),
        ("d", 0): ("111223333", "Jane", "K", "Doe", 9, 1),
        (None, 6): ("222-33-4444", "Bob", "", "Roe", 6, 0),
    }
