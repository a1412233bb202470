"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: table folder; BENCH_CPUS: local cores; BENCH_QUERIES: comma list to override the selection.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from routelab.plans import catalog  # noqa: E402
from routelab.session import local_session  # noqa: E402

HEADLINE = [
    "stats_by_dataset_model", "global_stats", "oracle_accuracy", "oracle_cost_total", "random_router", "summary_long_ood", "split_by_prompt", "complete_grid",
    "to_wide_prompts", "encode_ids", "pair_models", "evaluate_selection", "pairwise_report", "pareto_join", "exact_quantiles", "slopes", "to_triplets",
    "stratified_negatives", "sweep", "run_cascade", "cascade_search", "knn_join", "route_by_cluster", "fit_balance_router", "keep_latest_run", "fingerprint",
    "token_f1", "qa_normalize", "score_math", "score_multiple_choice", "score_rule_tasks",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    catalog.load()
    spark = local_session(cpus, "bench")
    # one warm-up scan so that the first query does not carry the start of the session
    catalog.QUERIES["stats_by_dataset_model"](spark, d).write.mode("overwrite").format("noop").save()
    times = {}
    for n in names:
        t = time.time()
        catalog.QUERIES[n](spark, d).write.mode("overwrite").format("noop").save()
        times[n] = round(time.time() - t, 3)
        print(f"{n} {times[n]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
