"""Live request metrics per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from premia.settings import LATENCY_BUCKETS
from premia.streaming.files import read_batches, write_batch


def windowed_metrics(requests: DataFrame, time: str = "at", window: str = "1 day",
                     delay: str = "1 hour", buckets: tuple[float, ...] = LATENCY_BUCKETS
                     ) -> DataFrame:
    """Requests, latency sum and cumulative buckets per window, method, endpoint and status.

    ``time`` must be a timestamp with zone; requests later than ``delay`` are dropped.
    """
    bounds = [*buckets, float("inf")]
    return (
        requests.withWatermark(time, delay)
        .groupBy(F.window(time, window), "method", "endpoint", "status")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("latency").alias("latency_sum"),
             F.array(*[F.count_if(F.col("latency") <= b) for b in bounds]).alias("bucket_counts"))
        .select(F.col("window.start").alias("window_start"), "method", "endpoint", "status",
                "requests", "latency_sum", "bucket_counts")
    )


def stream_request_metrics(requests: DataFrame, out: str, **options) -> StreamingQuery:
    """Keep ``out/metrics`` up to date with the changed windows of each micro-batch."""
    return (
        windowed_metrics(requests, **options).writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: write_batch(batch, f"{out}/metrics", n))
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def current_metrics(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """The latest state of each window; ``like`` is the streamed frame, for its schema."""
    key = ["window_start", "method", "endpoint", "status"]
    values = ["requests", "latency_sum", "bucket_counts"]
    return read_batches(spark, f"{out}/metrics", like.schema).groupBy(*key).agg(
        F.max_by(F.struct(*values), "batch_id").alias("_latest")).select(*key, "_latest.*")
