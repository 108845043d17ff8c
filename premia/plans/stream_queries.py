"""Streaming queries: driver tables replayed as streams, results read back from the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from premia.plans.decision_queries import _TENANT_KEY, _TURNS_SQL, _rollup_sql
from premia.plans.registry import query
from premia.plans.tables import REQUEST_LOG_SQL, query_log_of, request_log_of, table
from premia.session import shared_folder
from premia.streaming.ingest import ingest_status, ingested_rows, stream_dedupe, stream_ingest
from premia.streaming.memory import rolled_up, stored_messages, stream_session_memory
from premia.streaming.metrics import current_metrics, stream_request_metrics, windowed_metrics


def replay(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a stream; a pattern path may be one file or a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(
        f"{sf_dir}/{name}.parque[t]")


@query("stream_ingest", """
    SELECT p.*, 2 AS refused FROM part p
""")
def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dropped as CSV files, half of them with columns the other way round and one more column; a file without
    a column and one whose keys are words are refused, each with all parts."""
    drop, out = shared_folder(spark, "drop"), shared_folder(spark, "ingest")
    parts = table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 2 == 1
    kinds = [
        parts.filter(~odd),
        parts.filter(odd).select(F.lit("x").alias("Left Over"), *reversed(parts.columns)),
        parts.drop("p_partkey").coalesce(1),
        parts.withColumn("p_partkey", F.lit("none of them")).coalesce(1),
    ]
    for kind in kinds:
        kind.write.mode("append").csv(drop, header=True)
    stream_ingest(spark, drop, parts.schema, out).awaitTermination()
    refused = ingest_status(spark, out).filter("status = 'failed'").agg(F.count(F.lit(1)).cast("int").alias("refused"))
    return ingested_rows(spark, out, parts.schema).crossJoin(F.broadcast(refused))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type, props FROM events")
def _stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "dedupe")
    events = replay(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "props")
    stream_dedupe(events, ["user_id", "event_type", "props"], "at", "60 days") \
        .writeStream.format("parquet").option("path", f"{out}/kept") \
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True) \
        .start().awaitTermination()
    return spark.read.parquet(f"{out}/kept").select("user_id", "event_type", "props")


@query("stream_request_metrics", f"""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, method, endpoint, status,
           count(*) AS requests, round(sum(latency), 4) AS latency_sum,
           count(*) FILTER (latency <= 0.5) AS under_half_second
    FROM ({REQUEST_LOG_SQL}) r GROUP BY ALL
""")
def _stream_request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "metrics")
    requests = request_log_of(replay(spark, sf_dir, "events")).withColumn(
        "at", F.col("ts").cast("timestamp"))
    stream_request_metrics(requests, out).awaitTermination()
    return current_metrics(spark, out, windowed_metrics(requests)).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "method", "endpoint", "status",
        "requests", F.round("latency_sum", 4).alias("latency_sum"),
        F.get("bucket_counts", F.lit(6 + 1)).alias("under_half_second"))


def _remember(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    out = shared_folder(spark, "memory")
    log = query_log_of(replay(spark, sf_dir, "events"))
    stream_session_memory(log, out).awaitTermination()
    return out, log


@query("stream_session_memory", _rollup_sql(_TURNS_SQL, 4, 8, _TENANT_KEY))
def _stream_session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, log = _remember(spark, sf_dir)
    return rolled_up(spark, out, log.schema)


@query("stream_session_window", f"""
    SELECT tenant_id, session_id, message_index, turn_index, role, content
    FROM (SELECT *, max(turn_index) OVER (PARTITION BY tenant_id, session_id) + 1 AS turn_count
          FROM ({_TURNS_SQL}) t) m
    WHERE turn_count < 5 * (turn_index // 5) + 9
""")
def _stream_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, log = _remember(spark, sf_dir)
    return stored_messages(spark, out, log.schema)
