"""The whole question flow, and the first clean-up of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from premia.operators.columns import apply_column_tags, drop_all_null_columns, sanitize_columns
from premia.operators.embedding import count_terms, fit_tfidf
from premia.operators.memory import context_strings, recent_window
from premia.plans.decision import answer_questions
from premia.plans.decision_queries import _PROMPT_TAIL, _recent_sql, _window_sql
from premia.plans.document_queries import evidence_ctes, tenant_of, text_chunks
from premia.plans.registry import query
from premia.plans.tables import MESSAGES_SQL, messages, table
from premia.session import materialize, shared_folder
from premia.sources.tabular import read_dataset


def benchmark_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as asked questions; each third one is a scenario run."""
    stress = F.col("item_id") % 3 == 0
    no_ids = F.array().cast("array<string>")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("session_id"),
        tenant_of(F.col("item_id")).alias("tenant_id"),
        F.timestamp_seconds(F.col("item_id") * 60).cast("timestamp_ntz").alias("asked_at"),
        F.col("text").alias("question"),
        F.when(F.col("item_id") % 4 == 0, F.array(F.concat(F.lit("ds-"), "item_id")))
        .otherwise(no_ids).alias("dataset_ids"),
        no_ids.alias("document_ids"),
        F.when(stress, "Stress").alias("scenario_label"),
        F.when(stress, '{"claims_increase": 0.25}').alias("scenario_assumptions"),
        stress.alias("is_ephemeral"))


def prompt_length_reply(prompt):
    """Stands in for a language model: a fenced JSON reply that depends on the whole prompt."""
    return F.concat(F.lit('```json\n{"action": "Review '), F.length(prompt).cast("string"),
                    F.lit(' characters", "confidence": "medium"}\n```'))


_AUGMENTED = """text || CASE WHEN item_id % 3 = 0 THEN chr(10)
    || 'Scenario assumptions for this run: {"claims_increase": 0.25}' ELSE '' END"""


@query("decision_flow", f"""
    WITH {evidence_ctes(f"SELECT item_id AS question_id, {_AUGMENTED} AS text FROM benchmark")},
    texts AS (
        SELECT question_id, string_agg('Evidence ' || rank || ' [Doc ' || substr(document_id, 1, 8)
                   || ', p.' || page || ']:' || chr(10) || text || chr(10), chr(10) ORDER BY rank)
                   AS document_evidence, count(*) AS n_chunks
        FROM evidence GROUP BY question_id),
    contexts AS ({_recent_sql(_window_sql(MESSAGES_SQL, 4))}),
    log AS (
        SELECT *, item_id % 10 AS session_id, {_AUGMENTED} AS asked,
               CASE WHEN item_id % 4 = 0 THEN item_id END AS own,
               last_value(CASE WHEN item_id % 4 = 0 AND item_id % 3 <> 0 THEN item_id END
                          IGNORE NULLS) OVER (PARTITION BY item_id % 10, item_id % 4 ORDER BY item_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried
        FROM benchmark)
    SELECT sha256('audit|' || item_id) AS id, l.session_id, l.text AS query_text,
           CASE WHEN item_id % 3 = 0 THEN 'Stress' END AS scenario_label,
           coalesce('ds-' || coalesce(own, carried), '') AS dataset_ids,
           coalesce(n_chunks, 0) AS n_chunks,
           'Review ' || length(concat(
               'Session context (prior conversation summary):', chr(10),
               coalesce(c.recent, 'No prior context.'), chr(10), chr(10), 'User question:',
               chr(10), asked, chr(10), chr(10),
               'DOCUMENT EVIDENCE (retrieved from uploaded PDFs):', chr(10),
               coalesce(document_evidence, 'No relevant document sections found.'), chr(10),
               chr(10), 'DATA EVIDENCE (SQL queries run against uploaded tables):', chr(10),
               'No structured data queries were run.', chr(10), chr(10), '{_PROMPT_TAIL}'))
               || ' characters' AS action
    FROM log l LEFT JOIN texts t ON l.item_id = t.question_id
    LEFT JOIN contexts c ON c.session_id = l.session_id
""")
def _decision_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = materialize(count_terms(text_chunks(spark, sf_dir)), "chunks")
    contexts = context_strings(recent_window(messages(spark, sf_dir)))
    audit = answer_questions(benchmark_log(spark, sf_dir), chunks, fit_tfidf(chunks),
                             prompt_length_reply, "prompt-length", contexts=contexts)
    return audit.select(
        "id", "session_id", "query_text", "scenario_label",
        F.array_join("active_dataset_ids", ",").alias("dataset_ids"),
        F.size("retrieved_chunks").cast("bigint").alias("n_chunks"), "recommendation.action")


@query("read_dataset", """
    SELECT c_custkey AS customer_key, c_name AS customer_name,
           CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS account_balance, c_nationkey > 12
               AS far_away
    FROM customer
""")
def _read_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a messy CSV file: odd names, NA tokens, an empty column, a column to ignore."""
    path = shared_folder(spark, "csv")
    table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Customer-Key"), F.col("c_name").alias("Customer Name"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal").cast("string")).otherwise("N/A")
        .alias("Account.Balance"),
        F.lit("null").alias("Nothing Here"), (F.col("c_nationkey") > 12).alias("FAR AWAY"),
        F.col("c_mktsegment").alias("Segment"),
    ).write.csv(path, header=True)
    frame = drop_all_null_columns(sanitize_columns(read_dataset(spark, path)))
    return apply_column_tags(frame, {"segment": "ignore", "account_balance": "target"})
