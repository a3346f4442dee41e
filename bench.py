"""Times headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from attest.plans import all_queries
from attest.session import local_session

HEADLINE = [
    "top_type_revenue", "priority_revenue", "scalar_aggs", "grouped_aggs", "multi_key_group", "median_by_group",
    "dedup_sum", "duplicate_profile", "month_over_month_by_customer", "filter_range_ops", "filter_in_table",
    "column_profile_orders", "column_profile_screen", "portfolio_totals", "date_ranges", "missing_months_by_customer",
    "key_overlap", "key_overlap_sketch", "reconcile_totals", "join_fanout", "reconcile_results", "rerun_match",
    "ordered_compare", "gate_missing_month", "ledger_chain", "ledger_latest", "redact_secrets", "month_mentions",
]
RUNS = 2


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": f"sum of the best of {RUNS} runs per query", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
