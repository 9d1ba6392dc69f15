"""Headline timings; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
local cores. Every query runs once untimed to warm the JVM, then once timed,
written to the no-op sink so that no result passes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bandwright.plans.catalogue import REGISTRY
from bandwright.sources.session import build_session

HEADLINE = [
    "panel_assembly", "dedup_lookup_join", "score_log_join", "exclusion_waterfall", "normalise_text",
    "class_bands", "sparse_profile", "cohort_share", "numeric_summary", "boxplot_stats",
    "latest_attributes", "point_biserial", "chi_square", "woe_table", "iv_numeric",
    "correlation_pairs", "select_features", "woe_encode", "auc_gini", "auc_gini_fractional",
    "roc_points", "ks_two_sample", "gains_table", "gains_by_sample", "gains_fractional",
    "segment_gains", "psi", "fit_compare", "score_population", "reload_parity",
    "attribution", "importance", "feature_ablation", "boruta", "search_trials",
]
# Model fits are long enough not to need a warm-up of their own.
COLD = {
    "fit_compare", "score_population", "reload_parity", "attribution", "select_features",
    "importance", "feature_ablation", "boruta", "search_trials",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in chosen:
        for timed in (False, True):
            if not timed and name in COLD:
                continue
            start = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
