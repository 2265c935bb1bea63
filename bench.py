"""Wall seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from solvens.plans import catalog  # noqa: E402
from solvens.session import get_session  # noqa: E402

HEADLINE = [
    "class_distribution",
    "clean_filings",
    "dedup_keep_first",
    "missing_report",
    "median_impute",
    "standard_scale",
    "corr_pairs",
    "latest_filing",
    "statement_metrics",
    "feature_vector",
    "yoy_growth",
    "growth_history",
    "group_split",
    "stratified_kfold",
    "classification_report",
    "model_comparison",
    "roc_curve",
    "roc_auc",
    "roc_macro_auc",
    "topk_attributions",
    "risk_factors",
    "health_snapshot",
    "risk_report",
    "smote",
    "train_lr",
    "train_rf",
    "train_boost",
    "tree_attributions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("solvens-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.all_queries()
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    # One small query first, so that the first figure is not the start of the JVM.
    registered["class_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
