"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelab.plans.queries import QUERIES  # noqa: E402
from tracelab.session import build_session  # noqa: E402

HEADLINE = [
    "cell_numbers",
    "intercell_timings",
    "initial_directions",
    "outgoing_positions",
    "position_differences",
    "windowed_counts",
    "bursts",
    "burst_aggregates",
    "burst_lengths",
    "master_matrix",
    "labelled_world",
    "merged_cells",
    "page_links",
    "site_classes",
    "stratified_folds",
    "interleave_plan",
    "standardised",
    "roc_points",
    "fold_metrics",
    "mean_roc",
    "knn_neighbours",
    "knn_vote",
    "append_examples",
    "model_gaussian_nb",
    "model_random_forest",
    "extra_tree_scores",
    "decision_tree_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    QUERIES["cell_numbers"](spark, folder).write.format("noop").mode("overwrite").save()  # start the engine
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
