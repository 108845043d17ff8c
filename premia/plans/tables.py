"""Stand-ins for the business tables, derived from the driver tables by plain projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from premia.operators.audit import CHUNK_TRACE, SQL_TRACE, audit_records
from premia.operators.recommendations import RECOMMENDATION_TYPE
from premia.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policy_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, read as a policy."""
    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    return (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("policy_id"),
            F.col("p_size").alias("age"),
            F.col("r_name").alias("region"),
            F.col("p_type").alias("vehicle_type"),
            F.col("l_extendedprice").alias("premium"),
            F.col("l_discount").alias("claim_frequency"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("claim_count"),
        )
    )


POLICY_BOOK_SQL = """
    SELECT l_orderkey * 10 + l_linenumber AS policy_id, p_size AS age, r_name AS region,
           p_type AS vehicle_type, l_extendedprice AS premium, l_discount AS claim_frequency,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS claim_count
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
"""


# --- uploads and the asset catalog, read from the documents ------------------

def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an uploaded file of its language's tenant."""
    kind = F.substring("source", 4, 2).cast("int") % 5
    extension = F.element_at(F.array(*map(F.lit, (".pdf", ".csv", ".XLSX", ".txt", ""))), kind + 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("upload_id"),
        F.col("lang").alias("tenant_id"),
        F.concat(F.lit("doc_"), "doc_id", extension).alias("original_filename"),
        F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"),
        (F.col("n_chars") * 4096).alias("file_size_bytes"),
        F.col("doc_id").alias("submitted_at"),
    )


UPLOADS_SQL = """
    SELECT doc_id AS upload_id, lang AS tenant_id,
           'doc_' || doc_id || (['.pdf', '.csv', '.XLSX', '.txt', ''])
               [substr(source, 4, 2)::int % 5 + 1] AS original_filename,
           sha256(text) AS file_hash, n_chars * 4096 AS file_size_bytes, doc_id AS submitted_at
    FROM documents
"""


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as registered assets: good ones ready, bad ones failed or pending."""
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(
        F.concat(F.lit("asset-"), "doc_id").alias("asset_id"),
        F.when(F.col("source").isin("src0", "src1", "src2"), "dataset")
        .otherwise("document").alias("kind"),
        F.col("lang").alias("tenant_id"),
        F.concat(F.lit("doc_"), "doc_id").alias("original_filename"),
        F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"),
        F.when(F.col("quality") == 1, "ready").when(F.col("toxic") == 1, "failed")
        .otherwise("pending").alias("upload_status"),
        (F.col("toxic") == 0).alias("is_active"),
        F.col("doc_id").alias("created_at"),
        (F.col("n_chars") > 500).alias("file_exists"),
        F.when(F.col("n_chars") > 300, F.floor(F.col("n_chars") / 1000).cast("bigint"))
        .alias("chunk_count"),
    )


DOCUMENT_CATALOG_SQL = """
    SELECT 'asset-' || doc_id AS asset_id,
           CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'dataset' ELSE 'document' END AS kind,
           lang AS tenant_id, 'doc_' || doc_id AS original_filename, sha256(text) AS file_hash,
           CASE WHEN quality = 1 THEN 'ready' WHEN toxic = 1 THEN 'failed' ELSE 'pending' END
               AS upload_status,
           toxic = 0 AS is_active, doc_id AS created_at, n_chars > 500 AS file_exists,
           CASE WHEN n_chars > 300 THEN n_chars // 1000 END AS chunk_count
    FROM documents JOIN labels USING (doc_id)
"""


def dataset_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as questions that name datasets: one by plain id, one malformed, one dashed."""
    key = F.get_json_object("props", "$.k")
    h = F.upper(F.md5(F.concat(F.lit("ds"), "user_id").cast("binary")))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                         F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("tenant_id"),
        F.array(F.md5(F.concat(F.lit("ds"), key).cast("binary")), F.lit("not-an-id"), dashed)
        .alias("dataset_ids"),
    )


def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as published datasets of five tenants; one brand is still pending."""
    tenant = F.element_at(
        F.array(*map(F.lit, ("view", "error", "purchase", "signup", "click"))),
        F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select(
        F.md5(F.concat(F.lit("ds"), "p_partkey").cast("binary")).alias("asset_id"),
        tenant.alias("tenant_id"),
        F.when(F.col("p_brand") == "Brand#2", "pending").otherwise("ready").alias("upload_status"),
        F.concat(F.lit("t_parts_"), "p_partkey").alias("table_name"),
        (F.col("p_type") != "PROMO").alias("has_schema"),
        F.floor("p_retailprice").cast("bigint").alias("row_count"),
    )


DATASET_CATALOG_SQL = """
    SELECT md5('ds' || p_partkey) AS asset_id,
           (['view', 'error', 'purchase', 'signup', 'click'])[p_size % 5 + 1] AS tenant_id,
           CASE WHEN p_brand = 'Brand#2' THEN 'pending' ELSE 'ready' END AS upload_status,
           't_parts_' || p_partkey AS table_name, p_type <> 'PROMO' AS has_schema,
           floor(p_retailprice)::bigint AS row_count
    FROM part
"""


# --- page blocks, read from documents, customers and nations ------------------

_BLOCK_COLUMNS = ["document_id", "tenant_id", "page", "kind", "table_index", "rows", "text"]


def prose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: one document per source and language, page number = doc_id."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.concat_ws("-", "source", "lang").alias("document_id"),
        F.col("lang").alias("tenant_id"), F.col("doc_id").alias("page"),
        F.lit("text").alias("kind"), F.lit(-1).alias("table_index"),
        F.lit(None).cast("array<array<string>>").alias("rows"), "text",
    )


def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long table per 400 customer keys and one short table of nations per region."""
    def cells(*columns) -> F.Column:
        return F.array(*columns, F.lit(None).cast("string"))

    def gather(df: DataFrame, key: str, row) -> DataFrame:
        # at most 400 keys, or one region's nations, per table
        ordered = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("r"))))
        return df.groupBy("document_id", "page", "table_index").agg(ordered["r"].alias("rows"))

    customers = gather(
        table(spark, sf_dir, "customer").select(
            F.lit("customers").alias("document_id"),
            F.floor(F.col("c_custkey") / 400).alias("page"), F.lit(0).alias("table_index"),
            "c_custkey", "c_name", "c_mktsegment", "c_nationkey"),
        "c_custkey", cells("c_name", F.concat(F.lit("  "), "c_mktsegment"),
                           F.col("c_nationkey").cast("string")))
    nations = gather(
        table(spark, sf_dir, "nation").select(
            F.lit("nations").alias("document_id"), F.lit(1).cast("bigint").alias("page"),
            F.col("n_regionkey").alias("table_index"), "n_nationkey", "n_name"),
        "n_nationkey", cells(F.col("n_nationkey").cast("string"), "n_name"))
    return customers.unionByName(nations).select(
        "document_id", F.lit("en").alias("tenant_id"), "page", F.lit("table").alias("kind"),
        "table_index", "rows", F.lit(None).cast("string").alias("text"))


def all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose_blocks(spark, sf_dir).select(*_BLOCK_COLUMNS).unionByName(
        table_blocks(spark, sf_dir).select(*_BLOCK_COLUMNS))


_SQL_BLANKS = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"

PROSE_CHUNKS_SQL = rf"""
    SELECT document_id, tenant_id, page, 'text' AS type, -1 AS table_index, NULL::int AS row_group,
           (start - 1) // 355 AS position,
           array_to_string(list_slice(w, start, start + 392), ' ') AS text
    FROM (SELECT *, unnest(generate_series(1, CASE WHEN len(w) <= 393 THEN 1
                           ELSE 1 + 355 * ceil((len(w) - 393) / 355.0)::bigint END, 355)) AS start
          FROM (SELECT source || '-' || lang AS document_id, lang AS tenant_id, doc_id AS page,
                       [x FOR x IN regexp_split_to_array(text, '{_SQL_BLANKS}') IF x <> ''] AS w
                FROM documents) d
          WHERE len(w) > 0) s
"""

TABLE_CHUNKS_SQL = r"""
    SELECT document_id, tenant_id, page, 'table' AS type, table_index,
           CASE WHEN big THEN part END AS row_group, part AS position,
           CASE WHEN big THEN array_to_string(list_slice(lines, 20 * part + 1, 20 * part + 20),
                                              chr(10))
                ELSE array_to_string(lines, chr(10)) END AS text
    FROM (SELECT *, unnest(CASE WHEN big THEN range(0, ((len(lines) - 1) // 20 + 1)::bigint)
                                ELSE [0] END) AS part
          FROM (SELECT *, list_sum([len(regexp_split_to_array(trim(x), '\s+')) FOR x IN lines]) > 1150
                             AS big
                FROM (SELECT 'customers' AS document_id, 'en' AS tenant_id,
                             c_custkey // 400 AS page, 0 AS table_index,
                             list(c_name || ' | ' || c_mktsegment || ' | ' || c_nationkey || ' | '
                                  ORDER BY c_custkey) AS lines
                      FROM customer GROUP BY ALL
                      UNION ALL
                      SELECT 'nations', 'en', 1, n_regionkey,
                             list(n_nationkey || ' | ' || n_name || ' | ' ORDER BY n_nationkey)
                      FROM nation GROUP BY ALL) t) b) p
"""

CHUNKS_SQL = f"""
    SELECT sha256(concat_ws('|', document_id, type, page, table_index, position)) AS chunk_id,
           document_id, tenant_id, page, type,
           row_number() OVER (PARTITION BY document_id
                              ORDER BY type, page, table_index, position) - 1 AS chunk_index,
           table_index, row_group, text
    FROM (SELECT * FROM ({PROSE_CHUNKS_SQL}) UNION ALL BY NAME SELECT * FROM ({TABLE_CHUNKS_SQL})) c
"""


# --- requests, queries and audit records, read from events --------------------

def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log_of(table(spark, sf_dir, "events"))


def request_log_of(events: DataFrame) -> DataFrame:
    """Events as HTTP requests; the value is the latency in hundredths of a second."""
    key = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.when(F.col("event_type").isin("view", "click"), "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/"), "event_type").alias("endpoint"),
        F.when(key < 90, 200).when(key < 97, 404).otherwise(500).alias("status"),
        (F.col("value") / 100).alias("latency"), "ts", "event_id",
    )


REQUEST_LOG_SQL = """
    SELECT CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method,
           '/api/' || event_type AS endpoint,
           CASE WHEN (props::json ->> 'k')::int < 90 THEN 200
                WHEN (props::json ->> 'k')::int < 97 THEN 404 ELSE 500 END AS status,
           value / 100 AS latency, ts, event_id
    FROM events
"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_log_of(table(spark, sf_dir, "events"))


def query_log_of(events: DataFrame) -> DataFrame:
    """Events as questions: a user is a session, errors are scenario runs, some name datasets."""
    key = F.get_json_object("props", "$.k").cast("int")
    no_ids = F.array().cast("array<string>")
    return events.select(
        F.col("event_id").alias("query_id"), F.col("user_id").alias("session_id"),
        F.concat(F.lit("tenant-"), F.col("user_id") % 3).alias("tenant_id"),
        F.col("ts").alias("asked_at"),
        F.concat(F.lit("Should we reprice "), "event_type", F.lit(" at "), key, F.lit("?"))
        .alias("question"),
        F.concat(F.lit("Move "), "event_type", F.lit(" by "), key, F.lit("%")).alias("action"),
        F.when(key < 20, F.array(F.concat(F.lit("ds-"), key))).otherwise(no_ids)
        .alias("dataset_ids"),
        F.when(key > 80, F.array(F.concat(F.lit("doc-"), key), F.lit("doc-0"))).otherwise(no_ids)
        .alias("document_ids"),
        F.when(F.col("event_type") == "error", "Stress").alias("scenario_label"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit('{"claims_increase": '), key, F.lit("}")))
        .alias("scenario_assumptions"),
        (F.col("event_type") == "error").alias("is_ephemeral"),
    )


QUERY_LOG_SQL = """
    SELECT event_id AS query_id, user_id AS session_id, 'tenant-' || (user_id % 3) AS tenant_id,
           ts AS asked_at, 'Should we reprice ' || event_type || ' at ' || k || '?' AS question,
           'Move ' || event_type || ' by ' || k || '%' AS action,
           CASE WHEN k < 20 THEN ['ds-' || k] ELSE []::varchar[] END AS dataset_ids,
           CASE WHEN k > 80 THEN ['doc-' || k, 'doc-0'] ELSE []::varchar[] END AS document_ids,
           CASE WHEN event_type = 'error' THEN 'Stress' END AS scenario_label,
           CASE WHEN event_type = 'error' THEN '{"claims_increase": ' || k || '}' END
               AS scenario_assumptions,
           event_type = 'error' AS is_ephemeral
    FROM (SELECT *, (props::json ->> 'k')::int AS k FROM events) e
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows as messages, two to a turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("message_index"),
        F.floor(F.col("turn") / 2).alias("turn_index"), "role", F.col("text").alias("content"))


MESSAGES_SQL = """
    SELECT conv_id AS session_id, turn AS message_index, turn // 2 AS turn_index, role,
           text AS content
    FROM conversations
"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation messages as model replies: JSON, fenced JSON, prose or JSON with bad fields.

    The message's place decides which; the text becomes the action.
    """
    place = F.col("turn") % 6
    confidence = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "certain"))),
                              (F.col("conv_id") % 4 + 1).cast("int"))
    body = F.to_json(F.struct(
        F.regexp_replace("text", r"[^\p{L} ]", "").alias("action"),
        confidence.alias("confidence"), F.col("role").alias("confidence_rationale"),
        F.array(F.struct(F.col("role").alias("text"), F.lit("memo").alias("source"),
                         F.col("turn").cast("int").alias("page"), F.lit("why").alias("relevance")))
        .alias("document_evidence"),
        F.array(F.lit("gap"), F.col("role")).alias("conflicts"),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("step 1"), F.lit("step 2"), F.lit("end")))
        .otherwise(F.array().cast("array<string>")).alias("reasoning_steps"),
    ))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("reply_id"), "conv_id", "turn", "role",
        "text",
        F.when(place == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```\nDone.")))
        .when(place == 2, F.concat(F.lit("  ```\n"), body, F.lit("```")))
        .when(place == 3, F.col("text"))
        .when(place == 4, F.regexp_replace(body, '"action"', '"act"'))
        .otherwise(body).alias("raw_model_output"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the query log as an audit record with SQL and chunk traces."""
    log = query_log(spark, sf_dir).withColumn("n", (F.col("query_id") % 5).cast("int"))
    sql = F.transform(
        F.sequence(F.lit(1), F.col("n")),
        lambda i: F.struct(
            F.concat(F.lit("SELECT "), i, F.lit(" FROM t_"), "session_id").alias("sql"),
            F.lit("[]").alias("rows_json"), i.cast("bigint").alias("row_count"),
            F.when(i == 4, "timeout").alias("error")))
    chunks = F.transform(
        F.sequence(F.lit(1), F.lit(6)),
        lambda i: F.struct(
            F.concat("question", F.lit(" chunk "), i).alias("text"),
            F.concat(F.lit("document-"), F.col("session_id")).alias("document_id"),
            (i + F.col("n")).cast("bigint").alias("page"), F.lit("text").alias("type"),
            i.cast("bigint").alias("chunk_index"), (1.0 / (i + 1)).alias("similarity_score"),
            F.lit(None).cast("double").alias("rerank_score")))
    recommendation = F.when(F.col("n") != 3, F.struct(
        F.col("action"), F.lit("high").alias("confidence"),
        F.lit("Strong signal").alias("confidence_rationale"),
        F.array().alias("document_evidence"), F.array().alias("sql_evidence"),
        F.when(F.col("n") == 1, F.array(F.lit("memo disagrees"), F.col("question")))
        .otherwise(F.array()).alias("conflicts"),
        F.array(F.lit("step 1")).alias("reasoning_steps"),
        F.array().alias("uncertainty_sources")).cast(RECOMMENDATION_TYPE))
    empty_sql, empty_chunks = F.array().cast(SQL_TRACE), F.array().cast(CHUNK_TRACE)
    results = log.withColumn(
        "sql_queries", F.when(F.col("n") > 0, sql.cast(SQL_TRACE)).otherwise(empty_sql)
    ).withColumn(
        "retrieved_chunks",
        F.when(F.col("n") % 2 == 0, chunks.cast(CHUNK_TRACE)).otherwise(empty_chunks)
    ).withColumn("recommendation", recommendation).withColumn(
        "raw_model_output", F.to_json("recommendation"))
    return audit_records(results, "model-l", "model-e")


AUDIT_LOG_SQL = f"""
    SELECT sha256('audit|' || query_id) AS id, tenant_id, session_id,
           sha256('recommendation|' || query_id) AS recommendation_id, question AS query_text,
           query_id, query_id % 5 AS n, action, asked_at AS created_at, scenario_label,
           scenario_assumptions, dataset_ids, document_ids
    FROM ({QUERY_LOG_SQL}) q
"""


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions on the records, many on the same few, some of them invalid."""
    key = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, ("accept", "reject", "review", "approve", "reject"))),
                          (key % 5 + 1).cast("int"))
    target = F.when(F.col("o_orderstatus") == "P", F.lit(1)).otherwise(F.col("o_custkey") * 3)
    return table(spark, sf_dir, "orders").select(
        key.alias("decision_id"),
        F.sha2(F.concat(F.lit("audit|"), target), 256).alias("audit_id"),
        F.concat(F.lit("tenant-"), F.col("o_custkey") % 3).alias("tenant_id"),
        action.alias("action"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "  ")
        .when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("comment"),
        F.col("o_orderdate").alias("decided_at"),
    )


DECISION_LOG_SQL = """
    SELECT o_orderkey AS decision_id,
           sha256('audit|' || CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_custkey * 3 END)
               AS audit_id,
           'tenant-' || (o_custkey % 3) AS tenant_id,
           (['accept', 'reject', 'review', 'approve', 'reject'])[o_orderkey % 5 + 1] AS action,
           CASE WHEN o_orderpriority = '1-URGENT' THEN '  '
                WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS comment,
           o_orderdate AS decided_at
    FROM orders
"""
