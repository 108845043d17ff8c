"""Live conversation memory: the batch rules, applied per micro-batch.

The state of a session is its messages that have not been rolled up yet, at most twice
``summarize_after`` of them. It is one small table per micro-batch, and a batch only reads the
one before it. Inside a batch the operators of ``premia.operators.memory`` do the work, so a
session that fills a micro-batch is numbered and cut into blocks by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from premia.operators.memory import conversation_turns, rollup_blocks, session_key
from premia.settings import SUMMARIZE_AFTER_TURNS, WINDOW_TURNS
from premia.streaming.files import read_batch, read_batches, write_batch


def _schemas(log: T.StructType) -> tuple[T.StructType, T.StructType]:
    """Messages and blocks of a log's sessions, with its tenants if it has them."""
    session = [T.StructField(c, log[c].dataType) for c in ("tenant_id", "session_id") if c in log.names]
    message = T.StructType([
        *session, T.StructField("message_index", T.LongType()),
        T.StructField("turn_index", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType())])
    block = T.StructType([*session, T.StructField("block", T.LongType()),
                          T.StructField("old_text", T.StringType())])
    return message, block


def advance_memory(stored: DataFrame, log: DataFrame, window: int, summarize_after: int
                   ) -> tuple[DataFrame, DataFrame]:
    """(messages stored afterwards, blocks rolled up now) after the queries in ``log``."""
    key = session_key(log)
    seen = stored.groupBy(*key).agg((F.max("turn_index") + 1).alias("_seen"))
    earlier = F.coalesce("_seen", F.lit(0))
    new = conversation_turns(log).join(seen, key, "left").select(
        *key, (F.col("message_index") + 2 * earlier).alias("message_index"),
        (F.col("turn_index") + earlier).alias("turn_index"), "role", "content")
    messages = stored.unionByName(new)
    blocks = rollup_blocks(messages, window, summarize_after)
    size = summarize_after - window + 1
    kept = messages.withColumn("block", F.floor(F.col("turn_index") / size)).join(
        blocks.select(*key, "block"), [*key, "block"], "left_anti")
    return kept.select(*stored.columns), blocks


def stream_session_memory(log: DataFrame, out: str, window: int = WINDOW_TURNS,
                          summarize_after: int = SUMMARIZE_AFTER_TURNS) -> StreamingQuery:
    """Roll up the sessions of a stream of answered queries (see ``conversation_turns``).

    Micro-batches must come in the order of time. Writes ``out/blocks`` (what was rolled up) and
    ``out/stored`` (what is kept verbatim).
    """
    message, _ = _schemas(log.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            stored = read_batch(spark, f"{out}/stored", batch_id - 1, message)
            kept, blocks = advance_memory(stored, batch, window, summarize_after)
            write_batch(blocks, f"{out}/blocks", batch_id)
            write_batch(kept, f"{out}/stored", batch_id)
        finally:
            batch.unpersist()

    return (
        log.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def rolled_up(spark: SparkSession, out: str, log: T.StructType) -> DataFrame:
    """All blocks rolled up so far; ``log`` is the schema of the stream."""
    return read_batches(spark, f"{out}/blocks", _schemas(log)[1]).drop("batch_id")


def stored_messages(spark: SparkSession, out: str, log: T.StructType) -> DataFrame:
    """The messages kept verbatim after the newest batch."""
    every = read_batches(spark, f"{out}/stored", _schemas(log)[0])
    newest = every.agg(F.max("batch_id").alias("batch_id"))
    return every.join(F.broadcast(newest), "batch_id", "left_semi").drop("batch_id")
