"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion into the no-op sink, so all columns of all rows are
computed and nothing is collected. One untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from worklens.plans.queries import QUERIES  # noqa: E402
from worklens.session import local_session  # noqa: E402

HEADLINE = (
    "s1_stderr_log_scan", "s2_json_log_scan", "s3_vector_log_scan", "s6_statement_scan",
    "f1_fingerprint", "f4_table_names", "f12_f14_retrieval_scores", "f15_destructive_flags",
    "f17_change_check", "f19_response_parsing", "f20_workload_report", "p1_trailing_window",
    "a1_workload_snapshot", "a1_daily_snapshots", "a2_pooled_statements", "a3_capture_summary",
    "a5_slo_evaluation", "a6_rag_evaluation", "a7_slo_compliance", "j1_history_deltas",
    "j4_long_retrieval_scores", "t2_top_impact_latest", "t9_top_entries", "k1_snapshot_upsert",
    "k3_retention", "r1_proposal_state", "r5_audit_log", "o1_profile_logs",
    "o2_profile_statements", "o6_run_all",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main(names: tuple[str, ...]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["f3_query_type"](spark, sf_dir))
    times = {}
    for name in names:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    chosen = tuple(sys.argv[1:]) or HEADLINE
    main(tuple(QUERIES) if chosen == ("all",) else chosen)
