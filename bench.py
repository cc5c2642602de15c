"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from freshness.session import build_session

HEADLINE = [
    "asof_left", "staleness_by_user", "count_before", "count_windows", "rolling", "per_key_half_split", "squash_rows",
    "error_by_group", "rank_total_error", "rank_query_proportional", "take_budget_rounds", "ridge_fold_in", "gram_sums",
    "sgd_fold", "als_train", "seasonal_means", "seasonal_forecast", "mase", "split_sentences", "changed_sentences",
    "rank_passages", "hit_at_k", "policy_results", "stream_count_windows", "stream_maintain",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    from freshness.plans.catalog import QUERIES

    def once(name):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
