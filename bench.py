"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from panelcast.plans import catalog
from panelcast.plans.importance_bench import importance_98
from panelcast.session import local_session

HEADLINE = [
    "f1_total_by", "f3_entity_profile", "f8_period_rollup", "g1_rank_first", "g2_add_lags", "g3_centered_mean", "h1_rank_entities",
    "k4_outlier_table", "k5_skim_numeric", "l1_histogram", "l3_boxplot_stats", "m1_decompose", "e6_neighbor_join", "v4_neighbor_report",
    "n0_gram", "n1_correlation_matrix", "o3_impute_simple", "p1_scaler", "q1_cluster_features", "q7_cluster_mean", "r2_importance_nonpara",
    "r3_importance_all", "s1_chrono_split", "t1_linear_model", "t2_ridge_cv", "t3_elastic_net", "u8_per_entity", "w2_forecast_fitted",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: catalog.QUERIES[name] for name in HEADLINE}
    runs["r3_importance_98x357"] = importance_98
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executor threads outside the timings
    spark.range(8).mapInPandas(lambda it: it, "id long").count()
    times = {}
    for name, fn in runs.items():
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
