"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from lokalis.plans import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["gw_mean_gaussian_fixed", "gw_mean_bisquare_fixed", "gw_mean_orders", "nearest_by_rings", "grid_range_join", "gw_average", "gw_correlation", "gw_quantiles", "gwr_coefficients", "gwr_basic", "gwpca", "gtwr", "z_scores", "filter_expression"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["layer_statistics"](spark, SF_DIR).collect()  # start-up of the JVM and, with the next one, of the Python workers
    catalog.QUERIES["nearest_neighbours"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
