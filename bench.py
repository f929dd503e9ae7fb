"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from txloom.queries import QUERIES
from txloom.session import clear_scratch

HEADLINE = [
    "c1_left_join", "d5_distinct_counts", "d10_spearman", "d11_auc", "e3_group_ratios", "e4_user_stats", "f4_negative_sampling",
    "g1_count_full", "g2_count_per_split", "g4_category_limit", "g5_shared_dictionary", "g8_pruned_ratios",
    "g9_target_encode", "h10_device_block", "h14_pairs", "h22_pairwise_ratios", "i2_stratified_kfold", "i3_group_kfold",
    "k3_previous_label", "k9_sequence_features", "k10_trailing_activity", "k11_past_target_mean",
    "k17_kolmogorov_smirnov", "k20_rank_blend", "k22_client_quantile", "panel_group_ratios", "e1_feature_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["d1_frequency_table"](spark, folder).count()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
