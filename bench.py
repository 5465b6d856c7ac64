"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_RUNS the timed
runs after one warm-up. Results are written to the no-op sink, so every row is produced.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from microfolio.catalog import QUERIES  # noqa: E402
from microfolio.session import local_session, remove_stages  # noqa: E402

HEADLINE = [
    "k1_daily_payments",
    "k4_waterfall_total",
    "k4_waterfall",
    "k5_capital_decrease",
    "e1_version_counter",
    "e8_scd2",
    "j9_loan",
    "j12_loan_balance",
    "j20_loan_scoring",
    "j24_event_scoring",
    "l3_reconcile_1",
    "l9_later_capital",
    "l11_final_schedule",
    "l19_account_conservation",
    "m1_weighted_delay",
    "m2_daily_balances",
    "m3_advance_cover",
    "m4_payment_score",
    "m5_active_customers",
    "m6_missing_months",
    "p1_history_box",
    "p6_arrears_summary",
    "p12_customer_card",
    "q10_events_feed",
    "d19_quantiles",
    "d20_summary",
    "e19_priority",
    "l22_instalment_payments",
    "r1_merged_by_load",
    "m16_contract_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, "microfolio-bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    remove_stages(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median of warm runs)",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
