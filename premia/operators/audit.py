"""The append-only audit trail: records, decisions, paging, traces, exports, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from premia.functions.tenancy import scope_to_tenant
from premia.functions.text import citation, iso_time, minute_time, strip_blanks
from premia.settings import (
    AUDIT_PAGE_ROWS, DECISION_ACTIONS, PROMPT_VERSION, REPORT_BODY_CHARS, REPORT_CHUNK_CHARS,
    REPORT_CHUNKS, REPORT_CODE_CHARS, REPORT_SQL_QUERIES,
)

# --- fixed values: field order of an exported record -------------------------
EXPORT_FIELDS = (
    "id", "tenant_id", "session_id", "recommendation_id", "query_text", "active_dataset_ids",
    "active_document_ids", "llm_model", "embed_model", "prompt_version", "sql_queries",
    "retrieved_chunks", "raw_model_output", "recommendation", "user_action", "user_comment",
    "action_at", "scenario_label", "scenario_assumptions", "created_at",
)
_TIMES = ("action_at", "created_at")

SQL_TRACE = "array<struct<sql: string, rows_json: string, row_count: bigint, error: string>>"
CHUNK_TRACE = ("array<struct<text: string, document_id: string, page: bigint, type: string, "
               "chunk_index: bigint, similarity_score: double, rerank_score: double>>")


def audit_records(results: DataFrame, llm_model: str, embed_model: str,
                  prompt_version: str = PROMPT_VERSION) -> DataFrame:
    """One finalized record per answered query, scenario runs included.

    ``results``: query_id, tenant_id, session_id, asked_at, question, dataset_ids, document_ids,
    sql_queries, retrieved_chunks, raw_model_output, recommendation, scenario_label,
    scenario_assumptions. Ids follow from the query id, so a repeated run makes the same record.
    """
    query = F.col("query_id").cast("string")
    return results.select(
        F.sha2(F.concat(F.lit("audit|"), query), 256).alias("id"), "tenant_id", "session_id",
        F.sha2(F.concat(F.lit("recommendation|"), query), 256).alias("recommendation_id"),
        F.col("question").alias("query_text"), F.col("dataset_ids").alias("active_dataset_ids"),
        F.col("document_ids").alias("active_document_ids"),
        F.lit(llm_model).alias("llm_model"), F.lit(embed_model).alias("embed_model"),
        F.lit(prompt_version).alias("prompt_version"), "sql_queries", "retrieved_chunks",
        "raw_model_output", "recommendation", F.lit(None).cast("string").alias("user_action"),
        F.lit(None).cast("string").alias("user_comment"),
        F.lit(None).cast("timestamp_ntz").alias("action_at"), "scenario_label",
        "scenario_assumptions", F.col("asked_at").alias("created_at"),
        F.lit(True).alias("is_finalized"),
    )


def append_audit(records: DataFrame, path: str) -> None:
    """Add records to the trail, one folder per tenant; nothing already there is touched.

    An id follows from its question, so a record that the trail has is not added again: a repeated append
    changes nothing. Ids are compared first, without the records: these are only shuffled if some of them are known
    and others new, or if an id comes more than once. ``records`` is made twice, so store it if it is costly.
    Of the trail only ids are read. Appends to one trail must not run at the same time.
    """
    spark, key = records.sparkSession, ["tenant_id", "id"]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    trail = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    ids = records.select(*key, F.lit(1).alias("mine"), F.lit(0).alias("theirs"))
    if trail:
        there = spark.read.schema(records.select(*key).schema).parquet(path).select(*key)
        # an id that is null equals none
        ids = ids.unionByName(there.dropna().select(*key, F.lit(0).alias("mine"), F.lit(1).alias("theirs")))
    found = ids.groupBy(*key).agg(F.sum("mine").alias("mine"), F.max("theirs").alias("theirs")).filter("mine > 0")
    repeated, known, new = found.agg(
        F.count_if(F.col("mine") > 1), F.count_if(F.col("theirs") == 1), F.count_if(F.col("theirs") == 0)).first()
    if trail and not new:
        return
    if repeated:
        records = records.dropDuplicates(key)
    if known:
        # the files of the trail are listed above, so what is written here is not read
        records = records.join(there, key, "left_anti").select(records.columns)
    records.write.mode("append").partitionBy("tenant_id").parquet(path)


def apply_decisions(audit: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit with decisions, every decision with its status).

    ``decisions``: decision_id, audit_id, tenant_id, action, comment, decided_at. Status is one of
    invalid_action, comment_required, not_found, conflict, recorded, checked in that order. The
    first valid decision of a record wins; a record that has one already keeps it.
    """
    comment = strip_blanks(F.coalesce("comment", F.lit("")))
    refused = (
        F.when(F.col("action").isNull() | ~F.col("action").isin(*DECISION_ACTIONS),
               "invalid_action")
        .when((F.col("action") == "reject") & (comment == ""), "comment_required")
    )
    judged = decisions.withColumn("_refused", refused)
    key = ["audit_id", "tenant_id"]
    # reduced to one row per record in every task before the shuffle
    first = judged.filter(F.col("_refused").isNull()).groupBy(*key).agg(
        F.min(F.struct("decided_at", "decision_id", "action", "comment")).alias("_first"))
    records = audit.select(
        F.col("id").alias("audit_id"), "tenant_id",
        F.col("user_action").isNotNull().alias("_decided"))
    known = records.join(first, key, "left")
    status = (
        F.when(F.col("_refused").isNotNull(), F.col("_refused"))
        .when(F.col("_decided").isNull(), "not_found")
        .when(F.col("_decided") | (F.col("_first.decision_id") != F.col("decision_id")),
              "conflict")
        .otherwise("recorded")
    )
    statuses = judged.join(known, key, "left").select(*decisions.columns, status.alias("status"))
    joined = audit.join(first.withColumnRenamed("audit_id", "id"), ["id", "tenant_id"], "left")
    fresh = F.col("user_action").isNull()
    decided = joined.select(*[
        F.when(fresh, F.col(f"_first.{new}")).otherwise(F.col(old)).alias(old)
        if (new := {"user_action": "action", "user_comment": "comment",
                    "action_at": "decided_at"}.get(old)) else F.col(old)
        for old in audit.columns
    ])
    return decided, statuses


def audit_page(audit: DataFrame, tenant_id: str, limit: int = AUDIT_PAGE_ROWS, offset: int = 0
               ) -> DataFrame:
    """A page of a tenant's records, newest first; each task keeps limit + offset rows at most."""
    return scope_to_tenant(audit, tenant_id).orderBy(F.desc("created_at"), "id") \
        .offset(offset).limit(limit)


def audit_trace(audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(SQL trace, chunk trace): one row per statement and per retrieved chunk."""
    sql = audit.select("id", "tenant_id", F.posexplode("sql_queries").alias("position", "_e"))
    chunks = audit.select(
        "id", "tenant_id", F.posexplode("retrieved_chunks").alias("position", "_e"))
    return sql.select("id", "tenant_id", "position", "_e.*"), \
        chunks.select("id", "tenant_id", "position", "_e.*")


def audit_kpis(audit: DataFrame) -> DataFrame:
    """Records, accepted and pending decisions per tenant."""
    return audit.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.coalesce(F.col("user_action") == "accept", F.lit(False))).alias("accepted"),
        F.count_if(F.coalesce("user_action", F.lit("")) == "").alias("pending"))


def _as_json(text: Column) -> Column:
    """JSON text as the value it says; other text as a string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def _exported(name: str) -> Column:
    column = F.col(name)
    if name in _TIMES:
        return iso_time(column)
    if name in ("id", "tenant_id", "session_id", "recommendation_id"):
        return column.cast("string")
    if name == "scenario_assumptions":
        return _as_json(column)
    if name == "sql_queries":
        return F.transform(column, lambda q: F.struct(
            q["sql"].alias("sql"), _as_json(q["rows_json"]).alias("rows"),
            q["row_count"].alias("row_count"), q["error"].alias("error")))
    return column


def export_audit_json(audit: DataFrame, pretty: bool = False) -> DataFrame:
    """(id, json): the twenty exported fields in order, nulls kept.

    Ids are strings, times ISO-8601; assumptions and the rows of statements are JSON values, not text
    in quotes, unless they are no JSON.
    """
    fields = [_exported(c).alias(c) for c in EXPORT_FIELDS]
    options = {"ignoreNullFields": "false", **({"pretty": "true"} if pretty else {})}
    return audit.select("id", F.to_json(F.struct(*fields), options).alias("json"))


def _line(section: str, text: Column, limit: int = REPORT_BODY_CHARS) -> Column:
    return F.struct(F.lit(section).alias("section"), F.substring(text, 1, limit).alias("text"))


def _or_na(value: Column) -> Column:
    return F.coalesce(value, F.lit("N/A"))


def audit_report_lines(audit: DataFrame, title: str = "Pricing Recommendation") -> DataFrame:
    """The committee report of each record as lines: id, line_no, section, text. Narrow.

    Sections come in a fixed order and stay away when they are empty; body lines are cut at 2000
    characters, SQL at 1000, chunk texts at 400; the first 3 statements and 5 chunks are shown.
    """
    # fixed values: the labels and headings of the report, which results must match
    rec = F.col("recommendation")
    text_line = "array<struct<section: string, text: string>>"

    def only_if(present: Column, lines: Column) -> Column:
        return F.when(present, lines).otherwise(F.array().cast(text_line))

    def has_items(items: Column) -> Column:
        return F.coalesce(F.size(items) > 0, F.lit(False))

    head = F.array(
        _line("title", F.lit(title)),
        _line("title", F.concat(F.lit("Generated: "), minute_time(F.col("created_at")))),
        _line("title", F.concat(F.lit("Audit Record: "), F.col("id"))),
        _line("recommendation", _or_na(rec["action"])),
        _line("recommendation", F.concat(F.lit("Confidence: "), _or_na(rec["confidence"]))),
        _line("recommendation", F.concat(F.lit("Confidence Rationale: "),
                                         _or_na(rec["confidence_rationale"]))),
        _line("query", F.col("query_text")),
        _line("provenance", F.concat(
            F.lit("LLM: "), "llm_model", F.lit("  |  Embeddings: "), "embed_model",
            F.lit("  |  Prompt: "), "prompt_version")),
    )
    sql = F.flatten(F.transform(
        F.slice("sql_queries", 1, REPORT_SQL_QUERIES),
        lambda q: F.array(
            _line("sql_evidence", F.coalesce(q["sql"], F.lit("")), REPORT_CODE_CHARS),
            _line("sql_evidence", F.concat(
                F.lit("Rows returned: "),
                F.coalesce(q["row_count"], F.lit(0)).cast("string")))),
    ))
    chunks = F.flatten(F.transform(
        F.slice("retrieved_chunks", 1, REPORT_CHUNKS),
        lambda c: F.array(
            _line("document_evidence", citation(c["document_id"], c["page"], unknown="?")),
            _line("document_evidence", F.coalesce(c["text"], F.lit("")), REPORT_CHUNK_CHARS)),
    ))
    conflicts = F.transform(
        rec["conflicts"], lambda c: _line("conflicts", F.concat(F.lit("- "), c)))
    decision = F.array(
        _line("decision", F.concat(F.lit("Action: "), F.upper("user_action"))))
    comment = F.array(_line("decision", F.concat(F.lit("Comment: "), "user_comment")))
    decided = F.coalesce("user_action", F.lit("")) != ""
    lines = F.concat(
        head,
        only_if(has_items(F.col("sql_queries")), sql),
        only_if(has_items(F.col("retrieved_chunks")), chunks),
        only_if(has_items(rec["conflicts"]), conflicts),
        only_if(decided, decision),
        only_if(decided & (F.coalesce("user_comment", F.lit("")) != ""), comment),
    )
    return audit.select("id", F.posexplode(lines).alias("line_no", "_line")) \
        .select("id", "line_no", "_line.*")
