"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The inputs that the queries derive from the given tables (transactions, payslip lines and grids, accounts, snapshots) are
written once before, in as many even files as there are cores, and their time is reported apart as ``inputs``, so that the
queries time the operators (as the derivation leaves them, the grids lie in two files, which two tasks read). Each
query runs once to warm up and then $BENCH_RUNS times (default 3); the median counts. Every row of the result is
produced, and none is kept (the noop sink). With BENCH_INPUTS=derived the inputs are derived within every query, as in the
first two rounds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from cashweave.session import local_session, scratch_path
from fixtures import derive
from fixtures.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "b8_clean_silver", "e1_monthly_cashflow", "e2_spending_by_category", "e2_spending_by_category_keyed",
    "e3_paycheck_totals", "e4_paycheck_breakdown", "e7_paycheck_reconciliation",
    "e7_paycheck_reconciliation_keyed", "e8_money_flow_edges", "e8_money_flow_edges_keyed",
    "e9_savings_rate", "e9_savings_rate_keyed", "e11_net_worth_history", "e11_net_worth_history_keyed",
    "a13_payroll_bronze", "r12_top_categories", "r20_search_transactions", "r25_spending_by_merchant",
    "k6_k8_forecast_keyed",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def store_inputs(spark) -> float:
    """Write the derived inputs and let the queries read them; returns the seconds it took."""
    start = time.perf_counter()
    for name in ("transactions_raw", "payroll_lines", "payslip_grids", "accounts", "snapshots"):
        path = scratch_path(spark, f"bench-{name}")
        getattr(derive, name)(spark, SF_DIR).repartition(int(CPUS)).write.parquet(path)
        setattr(derive, name, lambda session, sf_dir, path=path: session.read.parquet(path))
    return time.perf_counter() - start


def main(names: list[str]) -> None:
    spark = local_session(CPUS, "cashweave-bench", **{"spark.sql.shuffle.partitions": CPUS})
    inputs = store_inputs(spark) if os.environ.get("BENCH_INPUTS", "stored") == "stored" else 0.0
    times = {}
    for name in names or HEADLINE:
        def run(name=name):
            return QUERIES[name](spark, SF_DIR)
        seconds(run)
        times[name] = round(statistics.median(seconds(run) for _ in range(RUNS)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "inputs": round(inputs, 3), "sf": os.path.basename(SF_DIR.rstrip("/"))[2:]}))


if __name__ == "__main__":
    main(sys.argv[1:])
