"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores,
BENCH_QUERIES optionally a comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Window, functions as F

from slatework.catalog import QUERIES
from slatework.session import local_session, settle

HEADLINE = [
    "entry_form_signal", "a1_entity_game_spine", "w1_last_n_form", "w5_team_rollup_30d", "w6_ratio_of_sums_30d", "w8_prior_pair_history",
    "w12_previous_location", "w13_rank_signal", "w14_slate_composite", "w18_percent_rank", "w21_time_folds", "w22_kelly", "j5_asof_latest",
    "j6_nearest_time", "j8_either_order", "j12_cascading_keys", "j15_contains_join", "a5_distinct_counts", "a13_mix_profile", "a14_top2_pivot",
    "a16_contact_pack", "a25_segment_roi", "a31_rematch_rates", "e2_resolution_exact_tiers", "f1_normalize_name", "f18_wind_components",
    "m6_auc_ap_brier", "m8_best_f1", "m11_thresholds", "m17_scenarios", "s4_upsert", "b_hitter_features", "b11_starter_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session("bench", cores=cpus, partitions=int(cpus))
    # A join, a window and a checkpoint over small tables start the JVM's code paths; they are not timed.
    nations, customers = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("nation", "customer"))
    joined = customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"])
    ranked = joined.withColumn("r", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("c_custkey")))
    settle(ranked).groupBy("n_name").agg(F.max("r")).collect()
    times = {}
    for name in chosen:
        begin = time.perf_counter()
        # The noop sink computes every row and column without moving them to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
