"""Conversation memory over a log of queries or a table of messages.

Messages: session_id, message_index (0, 1, 2 ... in a session), turn_index, role, content.
Two messages make a turn. Sessions belong to a tenant: wherever a table has a ``tenant_id``, a session is
known by tenant and id, and the results carry both. A table without that column holds one tenant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from premia.functions.text import speaker_line
from premia.operators.ordering import last_before, number_along
from premia.session import materialize
from premia.settings import (
    RECENT_SESSIONS, SUMMARIZE_AFTER_TURNS, SUMMARY_MESSAGE_CHARS, WINDOW_MESSAGE_CHARS,
    WINDOW_TURNS,
)

_HOUR = 3600


def hour_of(time: Column) -> Column:
    """Whole hours since the epoch; the default bucket along a session."""
    return F.floor(F.unix_timestamp(time.cast("timestamp")) / _HOUR)


def session_key(df: DataFrame) -> list[str]:
    """The columns that tell sessions apart."""
    return [c for c in ("tenant_id", "session_id") if c in df.columns]


def persistent(log: DataFrame) -> DataFrame:
    """Queries that reach memory; scenario runs never do."""
    return log.filter(~F.col("is_ephemeral"))


def conversation_turns(log: DataFrame, bucket: Column | None = None) -> DataFrame:
    """A user and an assistant message per persistent query, turns numbered per session.

    ``log``: query_id, session_id, asked_at, question, action, is_ephemeral.
    """
    numbered = number_along(
        persistent(log), session_key(log), ["asked_at", "query_id"],
        hour_of(F.col("asked_at")) if bucket is None else bucket, "turn_index")
    said = F.posexplode(F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit("assistant").alias("role"),
                 F.coalesce("action", F.lit("")).alias("content"))))
    key = session_key(log)
    return numbered.select(*key, "turn_index", said.alias("_side", "_said")).select(
        *key, (F.col("turn_index") * 2 + F.col("_side")).alias("message_index"),
        "turn_index", "_said.role", "_said.content")


def recent_window(messages: DataFrame, turns: int = WINDOW_TURNS,
                  chars: int = WINDOW_MESSAGE_CHARS) -> DataFrame:
    """The last ``2 * turns`` messages of each session, cut to ``chars``.

    The rank limit prunes every session to that many messages in each task before the shuffle.
    """
    key = session_key(messages)
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("message_index")))
    return messages.withColumn("_newest", newest).filter(F.col("_newest") <= 2 * turns).select(
        *key, "message_index", "turn_index", "role",
        F.substring("content", 1, chars).alias("content"))


def rollup_blocks(messages: DataFrame, window: int = WINDOW_TURNS,
                  summarize_after: int = SUMMARIZE_AFTER_TURNS) -> DataFrame:
    """The blocks of old turns that have been rolled up, with the text to summarise.

    Block b holds the ``summarize_after - window + 1`` turns from ``b`` times that; it is rolled up
    once the session has ``summarize_after + 1`` turns past the block's start. The block size
    bounds each group.
    """
    size = summarize_after - window + 1
    key = session_key(messages)
    turns = messages.groupBy(*key).agg((F.max("turn_index") + 1).alias("turn_count"))
    line = speaker_line(F.col("role"), F.col("content"), SUMMARY_MESSAGE_CHARS)
    lines = F.sort_array(F.collect_list(F.struct("message_index", line.alias("line"))))
    return (
        messages.withColumn("block", F.floor(F.col("turn_index") / size))
        .groupBy(*key, "block").agg(lines["line"].alias("lines"))
        .join(turns, key)
        .filter(F.col("turn_count") >= F.lit(size) * F.col("block") + summarize_after + 1)
        .select(*key, "block", F.array_join("lines", "\n").alias("old_text"))
    )


# --- fixed values: the labels in summary_prompt and context_strings, which results must match ---

def summary_prompt(previous: str | None, old_text: str) -> str:
    return (f"Previous summary:\n{'None' if previous is None else previous}"
            f"\n\nNew conversation to summarize:\n{old_text}")


def _fold(load: Callable[[], Callable[[list[str]], list[str]]]):
    """Arrow batches of (session key …, old_text), in order, to (session key …, context_summary)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summarize = load()
        open_: list[tuple] = []
        carried: list[str | None] = []
        types, names = [], []

        def rows(keys: list[tuple], summaries: list[str | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(zip(*keys), types)), pa.array(summaries, pa.string())], names)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            types, names = batch.schema.types[:-1], [*batch.schema.names[:-1], "context_summary"]
            waiting: list[list[str]] = [[] for _ in open_]
            for *key, text in zip(*columns):
                if not open_ or open_[-1] != tuple(key):
                    open_.append(tuple(key))
                    carried.append(None)
                    waiting.append([])
                waiting[-1].append(text)
            for turn in range(max(map(len, waiting), default=0)):
                # the next block of every session of the batch in one call of the model
                due = [i for i, texts in enumerate(waiting) if len(texts) > turn]
                replies = summarize([summary_prompt(carried[i], waiting[i][turn]) for i in due])
                if len(replies) != len(due):
                    raise ValueError(f"{len(replies)} summaries of {len(due)} prompts")
                for i, reply in zip(due, replies):
                    carried[i] = reply
            # the last session may go on in the next batch
            if len(open_) > 1:
                yield rows(open_[:-1], carried[:-1])
                del open_[:-1], carried[:-1]
        if open_:
            yield rows(open_, carried)

    return fold


def session_summaries(blocks: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(session_id, context_summary): each session's blocks folded in order.

    ``load`` runs once a task and returns the model, a function from prompts to as many summaries. One job for
    any number of blocks: rows are dealt by session, sorted, and read as a stream that carries only the summary of the
    session at hand, so the longest session costs time but no memory. The result is written to the shared
    folder, so later steps ask no model again.
    """
    key = session_key(blocks)
    schema = T.StructType([*(blocks.schema[c] for c in key), T.StructField("context_summary", T.StringType())])
    ordered = blocks.select(*key, "block", "old_text").repartition(*key).sortWithinPartitions(*key, "block")
    return materialize(
        ordered.select(*key, "old_text").mapInArrow(_fold(load), schema), "summaries")


def context_strings(window: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(session_id, context): summary part, recent part, a blank line between what is there.

    ``window`` comes from ``recent_window``, which bounds each session's rows.
    """
    line = F.concat(F.upper("role"), F.lit(": "), F.col("content"))
    lines = F.sort_array(F.collect_list(F.struct("message_index", line.alias("line"))))
    key = session_key(window)
    recent = window.groupBy(*key).agg(
        F.concat(F.lit("Recent conversation:\n"), F.array_join(lines["line"], "\n"))
        .alias("_recent"))
    if summaries is None:
        return recent.withColumnRenamed("_recent", "context")
    earlier = F.when(F.coalesce("context_summary", F.lit("")) != "", F.concat(
        F.lit("Summary of earlier discussion:\n"), "context_summary"))
    return recent.join(summaries.select(*key, earlier.alias("_earlier")), key, "full").select(
        *key, F.concat_ws("\n\n", "_earlier", "_recent").alias("context"))


def carry_forward_assets(log: DataFrame, ids: str = "dataset_ids", bucket: Column | None = None
                         ) -> DataFrame:
    """Add ``effective_<ids>``: the query's own ids, else the session's last non-empty ones.

    Ids of scenario runs are used by that run and never carried.
    """
    own = F.when(F.size(ids) > 0, F.col(ids))
    carried = last_before(
        log, session_key(log), ["asked_at", "query_id"],
        hour_of(F.col("asked_at")) if bucket is None else bucket,
        F.when(~F.col("is_ephemeral"), own), "_inherited")
    empty = F.array().cast(log.schema[ids].dataType)
    return carried.withColumn(f"effective_{ids}", F.coalesce(own, "_inherited", empty)) \
        .drop("_inherited")


def sessions(log: DataFrame) -> DataFrame:
    """One row per session; partial aggregates only, so a busy session is never gathered."""
    at = F.struct("asked_at", "query_id")
    lasting = ~F.col("is_ephemeral")

    def active(ids: str) -> Column:
        kept = F.when(lasting & (F.size(ids) > 0), at)
        return F.coalesce(F.max_by(ids, kept), F.array().cast("array<string>")) \
            .alias(f"active_{ids}")

    return log.groupBy("tenant_id", "session_id").agg(
        F.count_if(lasting).alias("turn_count"), active("dataset_ids"), active("document_ids"),
        F.min("asked_at").alias("created_at"), F.max("asked_at").alias("last_active_at"))


def recent_sessions(session_table: DataFrame, tenant_id: str, n: int = RECENT_SESSIONS
                    ) -> DataFrame:
    """A tenant's most recently active sessions."""
    return session_table.filter(F.col("tenant_id") == tenant_id) \
        .orderBy(F.desc("last_active_at"), "session_id").limit(n)
