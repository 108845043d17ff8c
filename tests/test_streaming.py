import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from premia.operators.memory import conversation_turns, rollup_blocks
from premia.streaming.ingest import ingest_status, ingested_rows, stream_dedupe, stream_ingest
from premia.streaming.files import read_batch
from premia.streaming.memory import (
    advance_memory, rolled_up, stored_messages, stream_session_memory,
)
from premia.streaming.metrics import current_metrics, stream_request_metrics, windowed_metrics
from test_decisions import make_log

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def test_ingest_folder(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    schema = T.StructType([T.StructField("Policy Id", T.StringType()),
                           T.StructField("premium", T.DoubleType())])
    (drop / "a.csv").write_text("Policy Id,premium\nP1,10.5\nP2,NA\n")
    (drop / "bad.csv").write_text("Policy Id,premium\nP3,cheap\nP4,1\n")
    stream_ingest(spark, str(drop), schema, out).awaitTermination()
    (drop / "b.csv").write_text("Policy Id,premium\nP5,7\n")
    stream_ingest(spark, str(drop), schema, out).awaitTermination()
    rows = ingested_rows(spark, out, schema).orderBy("policy_id").collect()
    assert [tuple(r) for r in rows] == [("P1", 10.5), ("P2", None), ("P5", 7.0)]
    status = {r["file_path"].rsplit("/", 1)[1]: (r["status"], r["row_count"], r["failed_rows"])
              for r in ingest_status(spark, out).collect()}
    assert status == {"a.csv": ("ready", 2, 0), "bad.csv": ("failed", 2, 1),
                      "b.csv": ("ready", 1, 0)}


def test_ingest_by_header(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    schema = T.StructType([T.StructField("Policy Id", T.StringType()),
                           T.StructField("premium", T.DoubleType())])
    for name, text in {
        "swapped.csv": "\ufeffpremium,Policy Id\n10.5,P1\n",
        "more.csv": '"Policy Id",note,"Premium"\n"P,2","a ""b""",2\n',
        "header.csv": "Policy Id,premium\n",
        "blank.csv": "\n",
        "empty.csv": "",
        "short.csv": "Policy Id\nP3\n",
        "ragged.csv": "Policy Id,premium\nP4,1,9\n",
        "with space.csv": "Policy Id,premium\nP5,5\n",
    }.items():
        (drop / name).write_text(text)
    stream_ingest(spark, str(drop), schema, out, max_files_per_batch=3).awaitTermination()
    rows = ingested_rows(spark, out, schema).orderBy("policy_id").collect()
    assert [tuple(r) for r in rows] == [("P,2", 2.0), ("P1", 10.5), ("P5", 5.0)]
    status = {r["file_path"].rsplit("/", 1)[1]: (r["status"], r["row_count"], r["reason"])
              for r in ingest_status(spark, out).collect()}
    assert status == {
        "swapped.csv": ("ready", 1, None), "more.csv": ("ready", 1, None), "header.csv": ("ready", 0, None),
        "blank.csv": ("failed", 0, "no header"), "short.csv": ("failed", 0, "missing columns: premium"),
        "ragged.csv": ("failed", 1, "rows that do not fit"), "with%20space.csv": ("ready", 1, None)}


def test_lost_state_is_an_error(spark, tmp_path):
    none = read_batch(spark, str(tmp_path / "state"), -1, T.StructType([T.StructField("a", T.LongType())]))
    assert none.count() == 0
    with pytest.raises(AnalysisException):
        read_batch(spark, str(tmp_path / "state"), 4, none.schema)


def write_parts(df, path, n_parts, order):
    """One file per part, written in order, so that a stream reads one per micro-batch."""
    import time
    for i in range(n_parts):
        df.filter(F.col("_part") == i).drop("_part").coalesce(1).sortWithinPartitions(order) \
            .write.mode("append").parquet(path)
        time.sleep(0.05)


def test_dedupe_and_metrics_over_batches(spark, tmp_path):
    rows = [(i % 4, "GET", "/a", 200, i / 100, T0 + dt.timedelta(hours=i), i // 30)
            for i in range(90)]
    df = spark.createDataFrame(rows, "k int, method string, endpoint string, status int, "
                               "latency double, at timestamp, _part int")
    path = str(tmp_path / "in")
    write_parts(df, path, 3, "at")

    def stream():
        return spark.readStream.schema(df.drop("_part").schema) \
            .option("maxFilesPerTrigger", 1).parquet(path)

    kept = str(tmp_path / "kept")
    stream_dedupe(stream(), ["k"], "at", "30 days").writeStream.format("parquet") \
        .option("path", kept).option("checkpointLocation", str(tmp_path / "c1")) \
        .trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(kept).collect()) == [0, 1, 2, 3]

    out = str(tmp_path / "metrics")
    stream_request_metrics(stream(), out).awaitTermination()
    live = {r["window_start"]: (r["requests"], r["bucket_counts"]) for r in
            current_metrics(spark, out, windowed_metrics(stream())).collect()}
    batch = {r["window_start"]: (r["requests"], r["bucket_counts"])
             for r in windowed_metrics(df.drop("_part")).collect()}
    assert live == batch and len(live) == 4


def blocks_of(df):
    return {(r["session_id"], r["block"]): r["old_text"] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 3])
def test_session_memory_over_batches(spark, tmp_path, parts):
    log, _ = make_log(spark, 60, ("s", "s", "u"))
    split = log.withColumn("_part", (F.col("query_id") / (60 / parts)).cast("int"))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(split, path, parts, "query_id")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream_session_memory(stream, out).awaitTermination()
    want = rollup_blocks(conversation_turns(log))
    assert blocks_of(rolled_up(spark, out, log.schema)) == blocks_of(want)
    kept = stored_messages(spark, out, log.schema)
    done = {(s, t) for s, b in blocks_of(want) for t in range(5 * b, 5 * b + 5)}
    rest = {(r["session_id"], r["message_index"]) for r in conversation_turns(log).collect()
            if (r["session_id"], r["turn_index"]) not in done}
    assert {(r["session_id"], r["message_index"]) for r in kept.collect()} == rest


def test_advance_memory_is_repeatable(spark):
    log, _ = make_log(spark, 30)
    empty = conversation_turns(log).limit(0)
    once = [sorted(map(str, df.collect())) for df in advance_memory(empty, log, 4, 8)]
    twice = [sorted(map(str, df.collect())) for df in advance_memory(empty, log, 4, 8)]
    assert once == twice and once[1]
