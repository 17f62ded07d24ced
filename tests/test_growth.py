"""What queries cost as their tables grow: state calls, rows shuffled, plans."""

import random
import re
import types
from decimal import Decimal

from ledgerloom.operators import entities as en
from ledgerloom.operators import reconcile as rc
from ledgerloom.operators import vendors as vd
from ledgerloom.streaming import work_sessions as ws


class _State:
    """Value and map state of one client that counts its calls."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def _count(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._count(() in self.data)

    def get(self):
        return self._count(self.data.get(()))

    def update(self, value):
        self._count(self.data.update({(): value}))

    def clear(self):
        self._count(self.data.clear())

    def containsKey(self, key):  # noqa: N802
        return self._count(key in self.data)

    def getValue(self, key):  # noqa: N802
        return self._count(self.data.get(key))

    def updateValue(self, key, value):  # noqa: N802
        self._count(self.data.update({key: value}))

    def removeKey(self, key):  # noqa: N802
        self._count(self.data.pop(key, None))


class _Handle:
    def __init__(self):
        self.states, self.timers, self.registered = {}, set(), 0

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, _State())

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.registered += 1


def _fire(sessions, handle, upto):
    """Timers up to the watermark, as one batch fires them; those set meanwhile wait."""
    out = []
    mark = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: upto)
    for at in sorted(t for t in handle.timers if t <= upto):
        handle.timers.discard(at)
        out += sessions.handleExpiredTimer((1,), mark, types.SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
    return [(r.seq, r.ms, r.task, r.status, r.note) for r in out]


def test_sessions_cost_state_calls_per_batch_not_per_event(monkeypatch):
    """3,000 events of one client in three batches, runs of 64 rows in pages of 16."""
    monkeypatch.setattr(ws, "RUN_ROWS", 64, raising=False)
    monkeypatch.setattr(ws, "PAGE_ROWS", 16, raising=False)
    hour = 3_600_000
    events = [types.SimpleNamespace(ms=i * hour // 4, seq=i, action=("start", "hold", "resume", "finish")[i % 4], task=f"t{i % 3}", note="") for i in range(3000)]
    whole, handle = [], _Handle()
    sessions = ws.Sessions(8 * hour, 400 * 24 * hour)
    sessions.init(handle)
    for part in range(3):
        sessions.handleInputRows((1,), iter(events[part::3][::-1]), None)
        whole += _fire(sessions, handle, -1 if part < 2 else 400 * hour)
    whole += _fire(sessions, handle, 10**12)
    again, other = [], _Handle()
    single = ws.Sessions(8 * hour, 400 * 24 * hour)
    single.init(other)
    for e in events:
        single.handleInputRows((1,), iter([e]), None)
        again += _fire(single, other, e.ms)
    again += _fire(single, other, events[-1].ms + 9 * hour)
    again += _fire(single, other, 10**12)
    assert whole == again and len(whole) > 1000
    assert not any(s.data for s in handle.states.values())
    assert handle.registered < 20
    assert sum(s.calls for s in handle.states.values()) < 1000


def test_task_pairs_are_not_shuffled_to_be_made_distinct(spark):
    """40 tasks and 30 clients that all agree on their EIN, some on more, keys that repeat or are null."""
    tasks = [(i, i % 30 if i % 3 else None, "", f"N{i % 5}", "000000001") for i in range(40)] + [(3, 3, "", "N3", "000000001"), (4, 7, "", "x", "000000002"), (None, 1, "", "", "000000001"), (None, 2, "", "", "000000002")]
    clients = [(i, "", f"n{i % 5}", "000000001") for i in range(30)] + [(5, "", "n0", "000000001"), (6, "", "other", "000000002"), (None, "", "n1", "000000002")]
    t = spark.createDataFrame(tasks, "id long, client_idx long, client_id string, client_name string, ein string")
    c = spark.createDataFrame(clients, "client_idx long, id string, name string, ein string")

    def aliases(idx, ein, name):
        return {("e", ein)} | ({("i", idx)} if idx is not None else set()) | ({("n", name.lower())} if name else set())

    want = {(ci, ti) for ti, tx, _, tn, te in tasks for ci, _, cn, ce in clients if aliases(tx, te, tn) & aliases(ci, ce, cn)}
    out = en.tasks_for_clients(t, c)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # The pairs are the last thing made: no aggregate over all of them stands above the join.
    assert out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_vendor_lists_of_repeated_names_do_not_multiply(spark):
    """numbered names that hold the same threes, each row forty times; the loop says what is right."""
    names = [f"Customer#{i:09d}" for i in range(60)] + ["A", "Ring Co", "ring co"]
    paths = [f"/v/{n}.csv" if i % 3 == 0 else f"/v/zz {n.lower().replace('#', ' ')} list.xlsx" if i % 3 == 1 else f"/v/{n}.docx" for i, n in enumerate(names)]
    flat = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    want = {}
    for n in names:
        slug = re.sub("[^A-Za-z0-9_]+", "", re.sub(r"\s+", "_", n)).lower()
        exact = [f"{n}.csv", f"{slug}.csv", f"{slug}_vendor_list.csv", f"{n}.xlsx", f"{slug}.xlsx", f"{slug}_vendor_list.xlsx"]
        files = [(p.rsplit("/", 1)[1], p) for p in paths]
        found = [(exact.index(f), f, p) for f, p in files if f in exact]
        found += [(100, f, p) for f, p in files if re.search(r"\.(csv|xlsx|xls)$", f.lower()) and flat(n) in flat(f)]
        if found:
            want[n] = min(found)[2]
    many = lambda c, values: spark.createDataFrame([(v,) for v in values] * 40, f"{c} string")
    out = vd.pick_vendor_list(many("company", names), many("path", paths))
    assert {r.company: r.path for r in out.collect()} == want and len(want) > 40
    # One row per distinct side meets: the joins read names, not their copies, and long names meet by many letters.
    assert vd.term_keys(many("t", [n.lower() for n in names[:60]]), "t").groupBy("__run").count().agg({"count": "max"}).first()[0] == 1


def test_federal_lines_cross_the_shuffle_once(spark, monkeypatch):
    """records over chunk borders, lines that share a position, gaps, against a plain loop."""
    monkeypatch.setattr(rc, "CHUNK_ROWS", 8, raising=False)
    rng = random.Random(18)
    texts = ["2024-01-02", "2024-03-04 x", "941", "2024/Q1", "1,234.56", "Settled", "Return", "Scheduled", "Confirmation", None]
    lines = [(f"d{i % 3}", i // 3 + rng.choice([0, 0, 0, 1]), rng.choice(texts)) for i in range(600)]
    for n in range(40):
        lines += [("e", n * 7 + i, t) for i, t in enumerate(["2024-01-02", "2024-01-01", "941", "2024/Q1", f"{n}.00", "Settled", "-"])]
    at = {}
    for doc, pos, text in lines:
        if text is not None:
            at.setdefault((doc, pos), []).append(text)
    want = set()
    for (doc, pos), here in at.items():
        first = max((t for t in here if t.startswith("2024-")), default=None)
        f = [max(at.get((doc, pos + i), [""])) for i in range(6)]
        if first and f[5] in ("Settled", "Return", "Scheduled") and re.fullmatch(r"[\d,]+(\.\d+)?", f[4]):
            want.add((doc, pos, first[:10], f[3], f[4].replace(",", ""), f[5].replace("Return", "Returned")))
    df = spark.createDataFrame(lines, "doc_id string, pos long, text string")
    out = rc.parse_federal_payments(df)
    got = [(r.doc_id, r.row_no, str(r.settlement_date), r.tax_period, r.amount, r.status) for r in out.collect()]
    assert sorted((d, p, a, b, Decimal(c), e) for d, p, a, b, c, e in want) == sorted((d, p, a, b or "", c, e) for d, p, a, b, c, e in got)
    assert sum(g[0] == "e" for g in got) == 40 and len(got) > 42
    assert "sequence(0, 5" not in out._jdf.queryExecution().optimizedPlan().toString() and "[0,1,2,3,4,5]" not in out._jdf.queryExecution().optimizedPlan().toString()
