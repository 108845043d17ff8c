"""Evidence texts, scenarios and prompts for many questions at once."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from premia.functions.text import citation

# --- fixed values: texts that stand in for missing evidence ------------------
NO_DOCUMENT_EVIDENCE = "No relevant document sections found."
NO_DATA_EVIDENCE = "No structured data queries were run."
NO_CONTEXT = "No prior context."
SAMPLE_ROWS = 5

# --- fixed values: headings of a prompt, in order ------------------------------
CONTEXT_HEADING = "Session context (prior conversation summary):\n"
QUESTION_HEADING = "\n\nUser question:\n"
DOCUMENT_HEADING = "\n\nDOCUMENT EVIDENCE (retrieved from uploaded PDFs):\n"
DATA_HEADING = "\n\nDATA EVIDENCE (SQL queries run against uploaded tables):\n"
SCENARIO_HEADING = "\nScenario assumptions for this run: "

INSTRUCTION = ("\n\nGive a structured pricing recommendation based on all of this evidence. List "
               "every contradiction between documents and data under \"conflicts\".")


def _joined(parts: list[str | Column], order: str, separator: str) -> Column:
    """Text parts of a group in order; the caller's rank bounds the group."""
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order), F.concat(*parts).alias("part"))))
    return F.array_join(pieces["part"], separator)


def format_document_evidence(hits: DataFrame) -> DataFrame:
    """One cited evidence text per question.

    ``hits``: question_id, rank, document_id, page, text; ranks run from 1 to the search's k.
    """
    return hits.groupBy("question_id").agg(_joined(
        [F.lit("Evidence "), F.col("rank").cast("string"), F.lit(" "),
         citation(F.col("document_id"), F.col("page")), F.lit(":\n"), F.col("text"), F.lit("\n")],
        "rank", "\n").alias("document_evidence"))


def format_sql_evidence(results: DataFrame) -> DataFrame:
    """One text per question over its SQL results.

    ``results``: question_id, query_no (from 1), sql, rows_json (array of JSON objects),
    row_count, error. Failed statements show the error, others their count and five rows.
    """
    sample = F.concat(F.lit("["), F.array_join(F.slice("rows_json", 1, SAMPLE_ROWS), ", "),
                      F.lit("]"))
    number = F.col("query_no").cast("string")
    failed = F.concat(F.lit("Query "), number, F.lit(" (FAILED: "), F.col("error"),
                      F.lit("):\n"), F.col("sql"), F.lit("\n"))
    worked = F.concat(F.lit("Query "), number, F.lit(":\n"), F.col("sql"), F.lit("\nReturned "),
                      F.col("row_count").cast("string"), F.lit(" rows. Sample: "), sample,
                      F.lit("\n"))
    return results.groupBy("question_id").agg(_joined(
        [F.when(F.coalesce("error", F.lit("")) != "", failed).otherwise(worked)],
        "query_no", "\n").alias("sql_evidence"))


def with_scenario(question: Column, assumptions: Column) -> Column:
    """The question, plus its assumptions as JSON when there are any."""
    return F.when(
        F.coalesce(assumptions, F.lit("")).isin("", "{}"), question
    ).otherwise(F.concat(question, F.lit(SCENARIO_HEADING), assumptions))


def expand_scenarios(questions: DataFrame, scenarios: list[tuple[str, Mapping]]) -> DataFrame:
    """Each question under each of two or three scenarios (label, assumptions). Narrow."""
    if not 2 <= len(scenarios) <= 3:
        raise ValueError("a comparison takes two or three scenarios")
    choices = F.array(*[
        F.struct(F.lit(label).alias("scenario_label"),
                 F.lit(json.dumps(dict(assumptions))).alias("scenario_assumptions"))
        for label, assumptions in scenarios
    ])
    return questions.withColumn("_scenario", F.explode(choices)).select(
        *questions.columns, "_scenario.*",
        with_scenario(F.col("question"), F.col("_scenario.scenario_assumptions"))
        .alias("augmented_question"),
    )


def assemble_prompts(questions: DataFrame, document_evidence: DataFrame | None = None,
                     sql_evidence: DataFrame | None = None) -> DataFrame:
    """The synthesis prompt of each question.

    ``questions``: question_id, question (already augmented), context. The evidence tables hold one
    row per question, as the formatters make them.
    """
    joined = questions
    for name, evidence in (("document_evidence", document_evidence),
                           ("sql_evidence", sql_evidence)):
        joined = (joined.join(evidence, "question_id", "left") if evidence is not None
                  else joined.withColumn(name, F.lit(None).cast("string")))
    context = F.when(F.coalesce("context", F.lit("")) != "", F.col("context")).otherwise(NO_CONTEXT)
    return joined.select("question_id", F.concat(
        F.lit(CONTEXT_HEADING), context, F.lit(QUESTION_HEADING), F.col("question"),
        F.lit(DOCUMENT_HEADING), F.coalesce("document_evidence", F.lit(NO_DOCUMENT_EVIDENCE)),
        F.lit(DATA_HEADING), F.coalesce("sql_evidence", F.lit(NO_DATA_EVIDENCE)),
        F.lit(INSTRUCTION),
    ).alias("prompt"))


def compare_scenarios(results: DataFrame, labels: list[str], fields: list[str]) -> DataFrame:
    """One row per question: each field under each label side by side, and whether it differs.

    A question has one result per label, so its group holds at most three rows.
    """
    wide = results.groupBy("question_id").pivot("scenario_label", labels).agg(
        *[F.first(f).alias(f) for f in fields])
    differs = []
    for field in fields:
        first, *others = [F.col(f"`{label}_{field}`" if len(fields) > 1 else f"`{label}`")
                          for label in labels]
        same = F.lit(True)
        for other in others:
            same = same & first.eqNullSafe(other)
        differs.append((~same).alias(f"{field}_differs"))
    return wide.select("*", *differs)
