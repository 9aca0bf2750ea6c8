"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "knn_graph mutual_knn consensus_knn consensus_mutual transition_max umap_connectivities matrix_stats agreement_lineitem agreement_customer "
    "projection_multires partition_match_jaccard annotate_hier propagate_k3 modularity cluster_stability soft_membership hierarchy_edges_weight "
    "cluster_profile_mean dotplot thin_poisson_totals leiden louvain"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tessera.plans.catalogue import QUERIES

    QUERIES["knn_graph"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
