"""Times the headline queries on one machine and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose the data and the cores. Each
query is computed in full and its rows discarded; names given as arguments replace the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tickloom.plans import load
from tickloom.session import build_session

HEADLINES = (
    "flagship_top_names_per_day", "a01_day_bars", "w01_daily_features", "w02_labels", "w03_entry_table",
    "j05_entry_exit_pairs", "a07_ranker_evaluation", "a08_threshold_sweep", "a09_best_k_per_day",
    "a10_walk_forward_folds", "w04_pct_rank", "k04_bounded_sample", "c01_charge_orders", "c05_whole_units",
    "c06_sequential_fills", "c07_call_premium", "p01_confidence_weights", "p02_edge_shares", "p03_best_book",
    "a15_ledger_fold", "a15_positions", "j13_apply_splits", "j07_merge_quotes", "w06_allocator", "a05_daily_profit",
    "a13_annual_vol", "w05_trend_flag", "d04_exits_cost_aware", "d05_exits_model", "d07_entries_topn",
    "d10_entries_cost_aware", "d11_entries_model", "r05_alerts", "s06_export_ranks", "t01_stream_bars")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    queries["flagship_top_names_per_day"](spark, sf).write.format("noop").mode("overwrite").save()    # warm the JVM
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
