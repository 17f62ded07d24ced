"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.  One warm-up on the
smallest query, then each query runs once and is fully consumed by a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "vendor_totals",
    "rule_longest_match",
    "vendor_fuzzy",
    "account_lookup",
    "card_match",
    "multiset_diff",
    "direct_match",
    "return_cancel",
    "split_pairs",
    "occurrences",
    "todo_feed",
    "parse_bank_sectioned",
    "parse_card_fixed",
    "section_tag",
    "tokenize_text",
    "client_tasks",
    "back_links",
    "one_way_links",
    "merge_clients",
    "worklog_union",
    "replay_sessions",
    "tracker_summary",
    "asof_doc",
    "unique_names",
    "punch_pairs",
    "payroll_sections",
    "checklist_pivot",
)


def main() -> None:
    from ledgerloom.catalog import all_queries
    from ledgerloom.plans.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    queries = all_queries()
    queries["tracker_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
