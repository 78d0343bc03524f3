"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["spgemm_supp_part", "gram", "checksum", "join_project", "flop_total", "compression_factor", "spmv_const", "pathsim_sps_topk", "pathsim_cpc", "pathsim_chain3", "triangle_count", "masked_edge_count", "gini", "exclusive_scan", "set_similarity_overlap"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from knotwork.plans import queries as catalogue

    table, took = catalogue.queries(), {}
    table["spmv_const"](spark, d).count()  # start workers and compile
    for name in HEADLINE:
        began = time.time()
        table[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
