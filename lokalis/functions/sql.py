"""The kernels and distances as functions of Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bodies in Spark SQL; ``b`` is a bandwidth, ``d`` a distance.
BODIES = {
    "gw_gaussian(d DOUBLE, b DOUBLE)": "exp(-(d / b) * (d / b) / 2)",
    "gw_exponential(d DOUBLE, b DOUBLE)": "exp(-d / b)",
    "gw_bisquare(d DOUBLE, b DOUBLE)": "CASE WHEN d > b THEN 0.0D ELSE pow(1 - (d / b) * (d / b), 2) END",
    "gw_tricube(d DOUBLE, b DOUBLE)": "CASE WHEN d > b THEN 0.0D ELSE pow(1 - pow(d / b, 3), 3) END",
    "gw_boxcar(d DOUBLE, b DOUBLE)": "CASE WHEN d > b THEN 0.0D ELSE 1.0D END",
    "gw_euclidean(ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE)": "sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))",
    "gw_manhattan(ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE)": "abs(ax - bx) + abs(ay - by_)",
    "gw_chebyshev(ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE)": "greatest(abs(ax - bx), abs(ay - by_))",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to this session's SQL; they are expanded into plans, so nothing runs row by row outside of them. Returns their names."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")
    return [h.split("(")[0] for h in BODIES]
