"""From a log of questions to audited recommendations, as one flow of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from premia.operators.audit import CHUNK_TRACE, SQL_TRACE, audit_records
from premia.operators.embedding import TfidfEmbedder, embed_chunks
from premia.operators.evidence import (
    assemble_prompts, format_document_evidence, format_sql_evidence, with_scenario,
)
from premia.operators.memory import carry_forward_assets, session_key
from premia.operators.recommendations import generate_recommendations
from premia.operators.retrieval import attach_texts, lexical_overlap, rerank, vector_top_k
from premia.session import materialize


def find_evidence(questions: DataFrame, chunks: DataFrame, embedder: TfidfEmbedder,
                  scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """The five best chunks of each question: top 20 by vector, re-scored by text.

    ``questions``: question_id, tenant_id, question and optionally document_ids. ``chunks`` comes
    from the chunk store, with or without ``count_terms``. Only ids and vectors go through the search;
    texts join the few hits.
    """
    kept = ["chunk_id", "tenant_id", "slot_counts" if "slot_counts" in chunks.columns else "text"]
    kept += ["document_id"] if "document_ids" in questions.columns else []
    found = vector_top_k(embedder.embed(questions, "question"),
                         embed_chunks(chunks.select(*kept), embedder))
    texts = ["text", "document_id", "page", "type", "chunk_index"]
    candidates = attach_texts(found, chunks, texts).join(
        questions.select("question_id", "question"), "question_id")
    return rerank(candidates, scorer)


def answer_questions(log: DataFrame, chunks: DataFrame, embedder: TfidfEmbedder,
                     generate: Callable[[Column], Column], llm_model: str,
                     sql_results: DataFrame | None = None, contexts: DataFrame | None = None
                     ) -> DataFrame:
    """Audit records for every query in ``log``, scenario runs included.

    ``log``: query_id, session_id, tenant_id, asked_at, question, dataset_ids, document_ids,
    scenario_label, scenario_assumptions, is_ephemeral. ``sql_results`` is keyed by question_id =
    query_id (see ``format_sql_evidence``); ``contexts`` holds session_id, context and, where sessions
    of several tenants may share an id, tenant_id.
    """
    log = carry_forward_assets(carry_forward_assets(log), "document_ids")
    asked = log.select(
        F.col("query_id").alias("question_id"), "tenant_id", "session_id",
        F.col("effective_document_ids").alias("document_ids"),
        with_scenario(F.col("question"), F.col("scenario_assumptions")).alias("question"))
    evidence = materialize(find_evidence(asked, chunks, embedder), "evidence")
    with_context = (asked.join(contexts, session_key(contexts), "left") if contexts is not None
                    else asked.withColumn("context", F.lit(None).cast("string")))
    prompts = assemble_prompts(
        with_context, format_document_evidence(evidence),
        format_sql_evidence(sql_results) if sql_results is not None else None)
    answered = generate_recommendations(prompts, generate)
    # at most five hits per question, and one result per statement of a question
    trace = F.sort_array(F.collect_list(F.struct(
        "rank", F.struct("text", "document_id", "page", "type", "chunk_index",
                         "similarity_score", "rerank_score").alias("chunk"))))
    chunk_trace = evidence.groupBy("question_id").agg(
        trace["chunk"].cast(CHUNK_TRACE).alias("retrieved_chunks"))
    results = answered.join(chunk_trace, "question_id", "left")
    if sql_results is not None:
        statement = F.struct(
            "sql", F.concat(F.lit("["), F.array_join("rows_json", ", "), F.lit("]"))
            .alias("rows_json"), "row_count", "error")
        listed = F.sort_array(F.collect_list(F.struct("query_no", statement.alias("result"))))
        results = results.join(
            sql_results.groupBy("question_id").agg(
                listed["result"].cast(SQL_TRACE).alias("sql_queries")), "question_id", "left")
    else:
        results = results.withColumn("sql_queries", F.lit(None).cast(SQL_TRACE))
    joined = log.select(
        "query_id", "tenant_id", "session_id", "asked_at", "question", "scenario_label",
        "scenario_assumptions", F.col("effective_dataset_ids").alias("dataset_ids"),
        F.col("effective_document_ids").alias("document_ids"),
    ).join(results.select(
        F.col("question_id").alias("query_id"), "raw_model_output", "recommendation",
        F.coalesce("retrieved_chunks", F.array().cast(CHUNK_TRACE)).alias("retrieved_chunks"),
        F.coalesce("sql_queries", F.array().cast(SQL_TRACE)).alias("sql_queries")), "query_id")
    return audit_records(joined, llm_model, embedder.name)
