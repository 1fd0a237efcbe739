"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tollway.session import local_session

HEADLINE = [
    "surface_features", "outcomes_with_quotes", "policy_oracle", "policy_random", "domain_table_fit", "oracle_gap", "quote_error",
    "evaluate_baselines", "cumulative_ledger", "sequential_ledger", "lambda_curve", "lambda_selection", "isotonic_calibration",
    "domain_moments", "benchmark_bilinear", "benchmark_stumps", "balanced_split", "data_identity", "train_and_route",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    from tollway.catalog import load

    queries = load().QUERIES
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("tier_scores")  # start the JVM paths and Python workers outside the timings
    times = {name: round(run(name), 3) for name in names}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
