"""Request counts and latency histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from premia.settings import LATENCY_BUCKETS


def request_counts(log: DataFrame) -> DataFrame:
    """Requests by method, endpoint and status."""
    return log.groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(log: DataFrame, buckets: tuple[float, ...] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative latency buckets by endpoint: one row per endpoint and upper bound.

    All buckets are filled in one pass with partial sums; the last bound is infinity, so its
    count is the number of requests.
    """
    bounds = [*buckets, float("inf")]
    wide = log.groupBy("endpoint").agg(
        F.sum("latency").alias("latency_sum"),
        F.array(*[F.count_if(F.col("latency") <= b) for b in bounds]).alias("_counts"))
    labels = F.array(*[F.lit(float(b)) for b in bounds])
    return wide.select(
        "endpoint", "latency_sum", F.explode(F.arrays_zip(labels.alias("le"), "_counts"))
        .alias("_b")
    ).select("endpoint", F.col("_b.le").alias("le"), F.col("_b._counts").alias("requests"),
             "latency_sum")
