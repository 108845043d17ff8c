"""Queries over evidence, prompts, scenarios, replies, memory, audit and request metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from premia.operators.audit import (
    append_audit, apply_decisions, audit_kpis, audit_page, audit_report_lines, audit_trace, export_audit_json,
)
from premia.operators.evidence import (
    assemble_prompts, compare_scenarios, expand_scenarios, format_document_evidence,
    format_sql_evidence,
)
from premia.operators.governed_sql import screen_sql_log
from premia.operators.memory import (
    carry_forward_assets, context_strings, conversation_turns, recent_sessions, recent_window,
    rollup_blocks, session_summaries, sessions,
)
from premia.operators.metrics import latency_histogram, request_counts
from premia.operators.recommendations import explode_recommendations, parse_recommendations
from premia.plans.document_queries import EVIDENCE_SQL_CTES, questions, top_evidence
from premia.plans.registry import query
from premia.plans.tables import (
    AUDIT_LOG_SQL, DECISION_LOG_SQL, MESSAGES_SQL, POLICY_BOOK_SQL, QUERY_LOG_SQL, REQUEST_LOG_SQL,
    audit_log, decision_log, messages, policy_book, query_log, replies, request_log, table,
)
from premia.session import materialize, shared_folder, spread

SCENARIOS = [("Base", {}), ("Stress", {"claims_increase": 0.25}),
             ("Boom", {"claims_increase": -0.1, "note": "growth"})]

# --- evidence, prompts, scenarios ----------------------------------------------

_DOCUMENT_EVIDENCE_SQL = """
    SELECT question_id, string_agg('Evidence ' || rank || ' [Doc ' || substr(document_id, 1, 8)
               || ', p.' || page || ']:' || chr(10) || text || chr(10), chr(10) ORDER BY rank)
               AS document_evidence
    FROM evidence GROUP BY question_id
"""


@query("document_evidence", f"WITH {EVIDENCE_SQL_CTES} {_DOCUMENT_EVIDENCE_SQL}")
def _document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_document_evidence(top_evidence(spark, sf_dir))


def sql_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vehicle type, as a question: its premium by region, and one failed statement."""
    book = policy_book(spark, sf_dir)
    by_region = book.groupBy("vehicle_type", "region").agg(
        F.count(F.lit(1)).alias("n"), F.max("age").alias("oldest"))
    # one row per region in each group
    rows = F.sort_array(F.collect_list(F.struct(
        "region", F.to_json(F.struct("region", "n", "oldest")).alias("json"))))
    worked = by_region.groupBy("vehicle_type").agg(rows["json"].alias("rows_json")).select(
        F.col("vehicle_type").alias("question_id"), F.lit(1).alias("query_no"),
        F.concat(F.lit("SELECT region, count(*) FROM t WHERE vehicle_type = '"), "vehicle_type",
                 F.lit("'")).alias("sql"),
        "rows_json", F.size("rows_json").cast("bigint").alias("row_count"),
        F.lit(None).cast("string").alias("error"))
    failed = table(spark, sf_dir, "part").select("p_type").distinct().select(
        F.col("p_type").alias("question_id"), F.lit(2).alias("query_no"),
        F.lit("SELECT * FROM other").alias("sql"),
        F.array().cast("array<string>").alias("rows_json"),
        F.lit(0).cast("bigint").alias("row_count"), F.lit("not allowed").alias("error"))
    return worked.unionByName(failed)


_SQL_EVIDENCE_SQL = f"""
    SELECT vehicle_type AS question_id,
           'Query 1:' || chr(10) || 'SELECT region, count(*) FROM t WHERE vehicle_type = '''
           || vehicle_type || '''' || chr(10) || 'Returned ' || count(*) || ' rows. Sample: ['
           || array_to_string(list_slice(list(json ORDER BY region), 1, 5), ', ') || ']' || chr(10)
           || chr(10) || 'Query 2 (FAILED: not allowed):' || chr(10) || 'SELECT * FROM other'
           || chr(10) AS sql_evidence
    FROM (SELECT vehicle_type, region, '{{"region":"' || region || '","n":' || n || ',"oldest":'
                 || oldest || '}}' AS json
          FROM (SELECT vehicle_type, region, count(*) AS n, max(age) AS oldest
                FROM ({POLICY_BOOK_SQL}) b GROUP BY ALL) g) r
    GROUP BY vehicle_type
"""


@query("sql_evidence", _SQL_EVIDENCE_SQL)
def _sql_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_sql_evidence(sql_results(spark, sf_dir))


_PROMPT_TAIL = ("Give a structured pricing recommendation based on all of this evidence. List "
                "every contradiction between documents and data under \"conflicts\".")


@query("prompts", f"""
    WITH {EVIDENCE_SQL_CTES}, texts AS ({_DOCUMENT_EVIDENCE_SQL})
    SELECT item_id AS question_id, concat(
        'Session context (prior conversation summary):', chr(10),
        CASE WHEN item_id % 2 = 0 THEN 'Earlier we looked at motor.' ELSE 'No prior context.' END,
        chr(10), chr(10), 'User question:', chr(10), b.text, chr(10), chr(10),
        'DOCUMENT EVIDENCE (retrieved from uploaded PDFs):', chr(10),
        coalesce(document_evidence, 'No relevant document sections found.'), chr(10), chr(10),
        'DATA EVIDENCE (SQL queries run against uploaded tables):', chr(10),
        'No structured data queries were run.', chr(10), chr(10), '{_PROMPT_TAIL}') AS prompt
    FROM benchmark b LEFT JOIN texts ON item_id = question_id
""")
def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).withColumn(
        "context", F.when(F.col("question_id") % 2 == 0, "Earlier we looked at motor."))
    return assemble_prompts(asked, format_document_evidence(top_evidence(spark, sf_dir)))


@query("prompts_with_data", f"""
    SELECT question_id, concat(
        'Session context (prior conversation summary):', chr(10), 'No prior context.', chr(10),
        chr(10), 'User question:', chr(10), 'Reprice ', question_id, '?', chr(10), chr(10),
        'DOCUMENT EVIDENCE (retrieved from uploaded PDFs):', chr(10),
        'No relevant document sections found.', chr(10), chr(10),
        'DATA EVIDENCE (SQL queries run against uploaded tables):', chr(10),
        sql_evidence, chr(10), chr(10), '{_PROMPT_TAIL}') AS prompt
    FROM ({_SQL_EVIDENCE_SQL}) e
""")
def _prompts_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = format_sql_evidence(sql_results(spark, sf_dir))
    asked = evidence.select(
        "question_id", F.concat(F.lit("Reprice "), "question_id", F.lit("?")).alias("question"),
        F.lit("").alias("context"))
    return assemble_prompts(asked, None, evidence)


_SCENARIO_VALUES = """(VALUES ('Base', '{}'), ('Stress', '{"claims_increase": 0.25}'),
    ('Boom', '{"claims_increase": -0.1, "note": "growth"}'))
    s(scenario_label, scenario_assumptions)"""


@query("scenario_expand", f"""
    SELECT item_id AS question_id, scenario_label, scenario_assumptions,
           CASE WHEN scenario_assumptions = '{{}}' THEN text
                ELSE text || chr(10) || 'Scenario assumptions for this run: '
                     || scenario_assumptions END AS augmented_question
    FROM benchmark, {_SCENARIO_VALUES}
""")
def _scenario_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).select("question_id", "question")
    return expand_scenarios(asked, SCENARIOS).drop("question")


@query("scenario_compare", f"""
    WITH answer AS (
        SELECT region || '/' || vehicle_type AS question_id,
               round(avg(premium), 2) AS premium, max(claim_count) AS claims,
               round(avg(premium) * 1.25, 2) AS stressed
        FROM ({POLICY_BOOK_SQL}) b GROUP BY region, vehicle_type)
    SELECT question_id, premium AS "Base_premium", claims AS "Base_claims",
           stressed AS "Stress_premium", claims AS "Stress_claims",
           premium IS DISTINCT FROM stressed AS premium_differs, false AS claims_differs
    FROM answer
""")
def _scenario_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = policy_book(spark, sf_dir).groupBy("region", "vehicle_type").agg(
        F.avg("premium").alias("p"), F.max("claim_count").alias("claims"))
    asked = book.select(F.concat_ws("/", "region", "vehicle_type").alias("question_id"),
                        F.lit("Reprice?").alias("question"), "p", "claims")
    answered = expand_scenarios(asked, SCENARIOS[:2]).withColumn("premium", F.round(
        F.col("p") * F.when(F.col("scenario_label") == "Stress", 1.25).otherwise(1.0), 2))
    return compare_scenarios(answered, ["Base", "Stress"], ["premium", "claims"])


# --- model replies ---------------------------------------------------------------

_REPLIES_SQL = """
    SELECT conv_id * 100 + turn AS reply_id, conv_id, turn, role, text,
           regexp_replace(text, '[^\\p{L} ]', '', 'g') AS action,
           (['high', 'medium', 'low', 'certain'])[conv_id % 4 + 1] AS confidence
    FROM conversations
"""
_PARSED_SQL = f"""
    SELECT *, CASE WHEN turn % 6 = 3 THEN 'invalid_json' WHEN turn % 6 = 4 THEN 'missing_action'
                   WHEN confidence = 'certain' THEN 'unknown_confidence' END AS problem
    FROM ({_REPLIES_SQL}) r
"""


@query("parse_recommendations", f"""
    SELECT reply_id, problem, CASE WHEN problem IS NULL THEN action END AS action,
           CASE WHEN problem IS NULL THEN confidence END AS confidence,
           CASE WHEN problem IS NULL THEN role END AS rationale
    FROM ({_PARSED_SQL}) p
""")
def _parse_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_recommendations(replies(spark, sf_dir)).select(
        "reply_id", "problem", "recommendation.action", "recommendation.confidence",
        F.col("recommendation.confidence_rationale").alias("rationale"))


@query("explode_recommendations", f"""
    WITH good AS (SELECT * FROM ({_PARSED_SQL}) p WHERE problem IS NULL)
    SELECT reply_id, 'document_evidence' AS section, 0 AS position, role AS item,
           'memo, p.' || turn || ' | why' AS detail FROM good
    UNION ALL SELECT reply_id, 'conflicts', 0, 'gap', NULL FROM good
    UNION ALL SELECT reply_id, 'conflicts', 1, role, NULL FROM good
    UNION ALL SELECT reply_id, 'reasoning_steps', i,
                     (['step 1', 'step 2', 'end'])[i + 1], NULL
              FROM good, range(3) t(i) WHERE conv_id % 2 = 0
""")
def _explode_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = parse_recommendations(replies(spark, sf_dir)).filter("problem IS NULL")
    return explode_recommendations(good, "reply_id")


# --- a log of generated statements ---------------------------------------------------

def sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as generated statements of twelve shapes; the user is one of 150 tenants."""
    user = F.col("user_id").cast("string")
    own = F.concat(F.lit("t_"), user, F.lit("_policies"))
    other = F.concat(F.lit("T_"), ((F.col("user_id") + F.col("event_id") % 3) % 150)
                     .cast("string"), F.lit("_policies"))
    shapes = [
        F.concat(F.lit("SELECT age FROM "), own, F.lit(" WHERE region = 'North'")),
        F.concat(F.lit("```sql\nSELECT * FROM "), own, F.lit(";\n```\nThis reads all.")),
        F.concat(F.lit("SELECT a.age FROM "), own, F.lit(" a JOIN "), other,
                 F.lit(" b ON a.id = b.id")),
        F.concat(F.lit("DROP TABLE "), own),
        F.lit("select * from pg_catalog.pg_tables"),
        F.concat(F.lit("SELECT age FROM "), own, F.lit(" UNION SELECT age FROM "), own),
        F.concat(F.lit("SELECT * FROM (SELECT age FROM "), own, F.lit(" UNION SELECT age FROM "),
                 other, F.lit(") q")),
        F.concat(F.lit("Sure: SELECT age FROM "), own, F.lit(" WHERE id IN (SELECT id FROM "),
                 other, F.lit(")")),
        F.concat(F.lit("SELECT age FROM "), own, F.lit(" limit, "), other),
        F.concat(F.lit("SELECT age FROM "), own, F.lit(' "order" JOIN '), other),
        F.concat(F.lit("SELECT age FROM "), own, F.lit(" WHERE id IN (FROM "), other, F.lit(")")),
        F.concat(F.lit("SELECT age FROM "), own, F.lit(" /* /* */ ' */ , "), other, F.lit(" /* ' */")),
    ]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("statement_id"), user.alias("tenant_id"),
        F.element_at(F.array(*shapes), (F.col("event_id") % 12 + 1).cast("int"))
        .alias("sql_text"))


@query("screen_sql_log", """
    WITH log AS (
        SELECT event_id AS statement_id, user_id::varchar AS tenant_id, event_id % 12 AS shape,
               't_' || user_id || '_policies' AS own,
               'T_' || ((user_id + event_id % 3) % 150) || '_policies' AS other,
               (user_id + event_id % 3) % 150 <> user_id AS foreign_table
        FROM events)
    SELECT statement_id, tenant_id,
           CASE shape WHEN 0 THEN 'SELECT age FROM ' || own || ' WHERE region = ''North'''
               WHEN 1 THEN 'SELECT * FROM ' || own
               WHEN 2 THEN 'SELECT a.age FROM ' || own || ' a JOIN ' || other || ' b ON a.id = b.id'
               WHEN 3 THEN 'DROP TABLE ' || own
               WHEN 4 THEN 'select * from pg_catalog.pg_tables'
               WHEN 5 THEN 'SELECT age FROM ' || own || ' UNION SELECT age FROM ' || own
               WHEN 6 THEN 'SELECT * FROM (SELECT age FROM ' || own || ' UNION SELECT age FROM '
                           || other || ') q'
               WHEN 7 THEN 'SELECT age FROM ' || own || ' WHERE id IN (SELECT id FROM ' || other || ')'
               WHEN 8 THEN 'SELECT age FROM ' || own || ' limit, ' || other
               WHEN 9 THEN 'SELECT age FROM ' || own || ' "order" JOIN ' || other
               WHEN 10 THEN 'SELECT age FROM ' || own || ' WHERE id IN (FROM ' || other || ')'
               ELSE 'SELECT age FROM ' || own || ' /* /* */ '' */ , ' || other || ' /* '' */'
           END AS statement,
           reason IS NULL AS ok, reason
    FROM (SELECT *, CASE WHEN shape = 3 THEN 'not_a_select' WHEN shape = 5 THEN 'top_level_set_operation'
                         WHEN shape = 4 THEN 'qualified_name'
                         WHEN shape IN (2, 6, 7, 8, 9, 10, 11) AND foreign_table THEN 'table_not_entitled'
                    END AS reason FROM log) l
""")
def _screen_sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spread(sql_log(spark, sf_dir), "statement_id")
    entitlements = table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("tenant_id"),
        F.concat(F.lit("t_"), "user_id", F.lit("_policies")).alias("table_name"))
    return screen_sql_log(log, entitlements)


# --- memory ----------------------------------------------------------------------------

_TURNS_SQL = f"""
    SELECT tenant_id, session_id, 2 * turn_index + side AS message_index, turn_index,
           (['user', 'assistant'])[side + 1] AS role,
           CASE WHEN side = 0 THEN question ELSE action END AS content
    FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, session_id
                                    ORDER BY asked_at, query_id) - 1 AS turn_index
          FROM ({QUERY_LOG_SQL}) q WHERE NOT is_ephemeral) t, (VALUES (0), (1)) s(side)
"""


_TENANT_KEY = "tenant_id, session_id"


def _window_sql(source: str, turns: int, chars: int = 600, key: str = "session_id") -> str:
    return f"""
    SELECT {key}, message_index, turn_index, role, substr(content, 1, {chars}) AS content
    FROM ({source}) m
    QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY message_index DESC) <= {2 * turns}
    """


def _rollup_sql(source: str, window: int, after: int, key: str = "session_id") -> str:
    size = after - window + 1
    return f"""
    SELECT {key}, turn_index // {size} AS block,
           string_agg(upper(role) || ': ' || substr(content, 1, 500), chr(10)
                      ORDER BY message_index) AS old_text
    FROM (SELECT *, max(turn_index) OVER (PARTITION BY {key}) + 1 AS turn_count
          FROM ({source}) m) t
    GROUP BY {key}, turn_index // {size}, turn_count
    HAVING turn_count >= {size} * (turn_index // {size}) + {after + 1}
    """


def _recent_sql(source: str) -> str:
    return f"""
    SELECT session_id, 'Recent conversation:' || chr(10) || string_agg(
               upper(role) || ': ' || content, chr(10) ORDER BY message_index) AS recent
    FROM ({source}) w GROUP BY session_id
    """


@query("turns", _TURNS_SQL)
def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_turns(query_log(spark, sf_dir))


@query("recent_window", _window_sql(MESSAGES_SQL, 2))
def _recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_window(messages(spark, sf_dir), turns=2)


@query("recent_window_turns", _window_sql(_TURNS_SQL, 4, key=_TENANT_KEY))
def _recent_window_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_window(conversation_turns(query_log(spark, sf_dir)))


@query("rollup_blocks", _rollup_sql(MESSAGES_SQL, 1, 2))
def _rollup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_blocks(messages(spark, sf_dir), window=1, summarize_after=2)


@query("rollup_blocks_turns", _rollup_sql(_TURNS_SQL, 4, 8, _TENANT_KEY))
def _rollup_blocks_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_blocks(conversation_turns(query_log(spark, sf_dir)))


@query("context_strings", f"""
    WITH blocks AS ({_rollup_sql(MESSAGES_SQL, 1, 2)}),
    recent AS ({_recent_sql(_window_sql(MESSAGES_SQL, 1))}),
    summary AS (
        SELECT session_id, 'Summary of earlier discussion:' || chr(10)
               || length(old_text) || ' characters up to block ' || block AS earlier
        FROM blocks
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY block DESC) = 1)
    SELECT session_id, concat_ws(chr(10) || chr(10), earlier, recent) AS context
    FROM recent FULL JOIN summary USING (session_id)
""")
def _context_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = messages(spark, sf_dir)
    blocks = rollup_blocks(talk, window=1, summarize_after=2)
    newest = blocks.groupBy("session_id").agg(F.max(F.struct("block", "old_text")).alias("b"))
    summary = newest.select("session_id", F.concat(
        F.length("b.old_text").cast("string"), F.lit(" characters up to block "),
        F.col("b.block").cast("string")).alias("context_summary"))
    return context_strings(recent_window(talk, turns=1), summary)


@query("session_summaries", f"""
    SELECT session_id, sum(length(old_text)) || ' characters in ' || count(*) || ' blocks'
               AS context_summary
    FROM ({_rollup_sql(MESSAGES_SQL, 1, 2)}) b GROUP BY session_id
""")
def _session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folded summary counts characters and blocks, in place of a language model."""

    def load():
        def summarize(prompts):
            replies = []
            for prompt in prompts:
                earlier = re.match(r"[^\n]*\n(\d+) characters in (\d+)", prompt)
                size, blocks = map(int, earlier.groups()) if earlier else (0, 0)
                text = prompt.split("New conversation to summarize:\n", 1)[1]
                replies.append(f"{size + len(text)} characters in {blocks + 1} blocks")
            return replies

        return summarize

    return session_summaries(
        rollup_blocks(messages(spark, sf_dir), window=1, summarize_after=2), load)


@query("carry_forward", f"""
    WITH log AS (SELECT * FROM ({QUERY_LOG_SQL}) q),
    carried AS (
        SELECT *, last_value(CASE WHEN len(dataset_ids) > 0 AND NOT is_ephemeral
                             THEN dataset_ids END IGNORE NULLS) OVER w AS ds,
               last_value(CASE WHEN len(document_ids) > 0 AND NOT is_ephemeral
                          THEN document_ids END IGNORE NULLS) OVER w AS docs
        FROM log WINDOW w AS (PARTITION BY tenant_id, session_id ORDER BY asked_at, query_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT query_id, session_id,
           array_to_string(CASE WHEN len(dataset_ids) > 0 THEN dataset_ids
                                ELSE coalesce(ds, []) END, ',') AS dataset_ids,
           array_to_string(CASE WHEN len(document_ids) > 0 THEN document_ids
                                ELSE coalesce(docs, []) END, ',') AS document_ids
    FROM carried
""")
def _carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = carry_forward_assets(carry_forward_assets(query_log(spark, sf_dir)), "document_ids")
    return both.select(
        "query_id", "session_id",
        F.array_join("effective_dataset_ids", ",").alias("dataset_ids"),
        F.array_join("effective_document_ids", ",").alias("document_ids"))


_SESSIONS_SQL = f"""
    SELECT tenant_id, session_id, count(*) FILTER (NOT is_ephemeral) AS turn_count,
           coalesce(array_to_string(last(dataset_ids ORDER BY asked_at, query_id)
               FILTER (NOT is_ephemeral AND len(dataset_ids) > 0), ','), '') AS active_dataset_ids,
           coalesce(array_to_string(last(document_ids ORDER BY asked_at, query_id)
               FILTER (NOT is_ephemeral AND len(document_ids) > 0), ','), '')
               AS active_document_ids,
           min(asked_at) AS created_at, max(asked_at) AS last_active_at
    FROM ({QUERY_LOG_SQL}) q GROUP BY tenant_id, session_id
"""


def _flat_sessions(df: DataFrame) -> DataFrame:
    for ids in ("active_dataset_ids", "active_document_ids"):
        df = df.withColumn(ids, F.array_join(ids, ","))
    return df


@query("sessions", _SESSIONS_SQL)
def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_sessions(sessions(query_log(spark, sf_dir)))


@query("sessions_recent", f"""
    SELECT * FROM ({_SESSIONS_SQL}) s WHERE tenant_id = 'tenant-1'
    ORDER BY last_active_at DESC, session_id LIMIT 20
""")
def _sessions_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_sessions(recent_sessions(sessions(query_log(spark, sf_dir)), "tenant-1"))


# --- audit -------------------------------------------------------------------------------

@query("audit_page", f"""
    SELECT id, tenant_id, query_text, created_at FROM ({AUDIT_LOG_SQL}) a
    WHERE tenant_id = 'tenant-2' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100
""")
def _audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = audit_page(audit_log(spark, sf_dir), "tenant-2", offset=100)
    return page.select("id", "tenant_id", "query_text", "created_at")


_DECIDED_CTES = f"""
    record AS (SELECT * FROM ({AUDIT_LOG_SQL}) a),
    judged AS (
        SELECT *, CASE WHEN action NOT IN ('accept', 'reject', 'review') THEN 'invalid_action'
                       WHEN action = 'reject' AND trim(coalesce(comment, '')) = ''
                       THEN 'comment_required' END AS refused
        FROM ({DECISION_LOG_SQL}) d),
    status AS (
        SELECT j.*, CASE WHEN refused IS NOT NULL THEN refused WHEN r.id IS NULL THEN 'not_found'
                         WHEN row_number() OVER (PARTITION BY audit_id, j.tenant_id, refused IS NULL
                                                 ORDER BY decided_at, decision_id) > 1
                         THEN 'conflict' ELSE 'recorded' END AS status
        FROM judged j LEFT JOIN record r ON r.id = j.audit_id AND r.tenant_id = j.tenant_id)
"""


@query("decisions", f"""
    WITH {_DECIDED_CTES}
    SELECT decision_id, audit_id, tenant_id, action, comment, decided_at, status FROM status
""")
def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_decisions(audit_log(spark, sf_dir), decision_log(spark, sf_dir))[1]


_DECIDED_SQL = f"""
    WITH {_DECIDED_CTES}
    SELECT r.*, s.action AS user_action, s.comment AS user_comment, s.decided_at AS action_at
    FROM record r LEFT JOIN (SELECT * FROM status WHERE status = 'recorded') s
        ON r.id = s.audit_id
"""


def decided_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_decisions(audit_log(spark, sf_dir), decision_log(spark, sf_dir))[0]


@query("audit_decided", f"""
    SELECT id, tenant_id, user_action, user_comment, action_at FROM ({_DECIDED_SQL}) d
""")
def _audit_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided_audit(spark, sf_dir).select(
        "id", "tenant_id", "user_action", "user_comment", "action_at")


@query("audit_kpis", f"""
    SELECT tenant_id, count(*) AS records, count(*) FILTER (user_action = 'accept') AS accepted,
           count(*) FILTER (user_action IS NULL) AS pending
    FROM ({_DECIDED_SQL}) d GROUP BY tenant_id
""")
def _audit_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_kpis(decided_audit(spark, sf_dir))


@query("audit_trace_sql", f"""
    SELECT id, tenant_id, i - 1 AS position, 'SELECT ' || i || ' FROM t_' || session_id AS sql,
           '[]' AS rows_json, i AS row_count, CASE WHEN i = 4 THEN 'timeout' END AS error
    FROM ({AUDIT_LOG_SQL}) a, range(1, 5) t(i) WHERE i <= n
""")
def _audit_trace_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_trace(audit_log(spark, sf_dir))[0]


@query("audit_trace_chunks", f"""
    SELECT id, tenant_id, i - 1 AS position, query_text || ' chunk ' || i AS text,
           'document-' || session_id AS document_id, i + n AS page, 'text' AS type,
           i AS chunk_index, round(1.0::double / (i + 1), 6) AS similarity_score
    FROM ({AUDIT_LOG_SQL}) a, range(1, 7) t(i) WHERE n % 2 = 0
""")
def _audit_trace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = audit_trace(audit_log(spark, sf_dir))[1].drop("rerank_score")
    return chunks.withColumn("similarity_score", F.round("similarity_score", 6))


@query("audit_report", f"""
    WITH a AS (SELECT * FROM ({_DECIDED_SQL}) d),
    lines AS (
        SELECT id, 0 AS part, 0 AS i, 0 AS j, 'title' AS section, 'Pricing Recommendation' AS text
        FROM a
        UNION ALL SELECT id, 0, 1, 0, 'title',
            'Generated: ' || strftime(created_at, '%Y-%m-%d %H:%M') || ' UTC' FROM a
        UNION ALL SELECT id, 0, 2, 0, 'title', 'Audit Record: ' || id FROM a
        UNION ALL SELECT id, 1, 0, 0, 'recommendation',
            CASE WHEN n = 3 THEN 'N/A' ELSE action END FROM a
        UNION ALL SELECT id, 1, 1, 0, 'recommendation',
            'Confidence: ' || CASE WHEN n = 3 THEN 'N/A' ELSE 'high' END FROM a
        UNION ALL SELECT id, 1, 2, 0, 'recommendation', 'Confidence Rationale: '
            || CASE WHEN n = 3 THEN 'N/A' ELSE 'Strong signal' END FROM a
        UNION ALL SELECT id, 2, 0, 0, 'query', query_text FROM a
        UNION ALL SELECT id, 3, 0, 0, 'provenance',
            'LLM: model-l  |  Embeddings: model-e  |  Prompt: v1.0' FROM a
        UNION ALL SELECT id, 4, i, 0, 'sql_evidence', 'SELECT ' || i || ' FROM t_' || session_id
            FROM a, range(1, 4) t(i) WHERE i <= n
        UNION ALL SELECT id, 4, i, 1, 'sql_evidence', 'Rows returned: ' || i
            FROM a, range(1, 4) t(i) WHERE i <= n
        UNION ALL SELECT id, 5, i, 0, 'document_evidence', '[Doc document, p.' || (i + n) || ']'
            FROM a, range(1, 6) t(i) WHERE n % 2 = 0
        UNION ALL SELECT id, 5, i, 1, 'document_evidence', query_text || ' chunk ' || i
            FROM a, range(1, 6) t(i) WHERE n % 2 = 0
        UNION ALL SELECT id, 6, 0, 0, 'conflicts', '- memo disagrees' FROM a WHERE n = 1
        UNION ALL SELECT id, 6, 1, 0, 'conflicts', '- ' || query_text FROM a WHERE n = 1
        UNION ALL SELECT id, 7, 0, 0, 'decision', 'Action: ' || upper(user_action)
            FROM a WHERE user_action IS NOT NULL
        UNION ALL SELECT id, 7, 1, 0, 'decision', 'Comment: ' || user_comment
            FROM a WHERE user_action IS NOT NULL AND user_comment <> '')
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, i, j) - 1 AS line_no, section, text
    FROM lines
""")
def _audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_report_lines(decided_audit(spark, sf_dir))


def _iso_sql(column: str) -> str:
    return (f"strftime({column}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({column}) % 1000000 = 0 "
            f"THEN '' ELSE strftime({column}, '.%f') END")


@query("audit_json", f"""
    WITH said AS (
        SELECT *, CASE WHEN n <> 3 THEN {{
            'action': action, 'confidence': 'high', 'confidence_rationale': 'Strong signal',
            'document_evidence': []::varchar[], 'sql_evidence': []::varchar[],
            'conflicts': CASE WHEN n = 1 THEN ['memo disagrees', query_text] ELSE [] END,
            'reasoning_steps': ['step 1'], 'uncertainty_sources': []::varchar[]}} END AS said
        FROM ({_DECIDED_SQL}) d)
    SELECT id, json_object(
        'id', id, 'tenant_id', tenant_id, 'session_id', session_id::varchar,
        'recommendation_id', recommendation_id, 'query_text', query_text,
        'active_dataset_ids', dataset_ids, 'active_document_ids', document_ids,
        'llm_model', 'model-l', 'embed_model', 'model-e', 'prompt_version', 'v1.0',
        'sql_queries', [{{'sql': 'SELECT ' || i || ' FROM t_' || session_id, 'rows': []::varchar[],
                          'row_count': i, 'error': CASE WHEN i = 4 THEN 'timeout' END}}
                        FOR i IN range(1, n + 1)],
        'retrieved_chunks', [{{'text': query_text || ' chunk ' || i, 'document_id': 'document-' || session_id,
                               'page': i + n, 'type': 'text', 'chunk_index': i,
                               'similarity_score': 1::double / (i + 1), 'rerank_score': NULL::double}}
                             FOR i IN range(1, CASE WHEN n % 2 = 0 THEN 7 ELSE 1 END)],
        'raw_model_output', CASE WHEN n <> 3 THEN to_json(said)::varchar END,
        'recommendation', said, 'user_action', user_action, 'user_comment', user_comment,
        'action_at', {_iso_sql("action_at")}, 'scenario_label', scenario_label,
        'scenario_assumptions', scenario_assumptions::json, 'created_at', {_iso_sql("created_at")})::varchar AS json
    FROM said
""")
def _audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_audit_json(decided_audit(spark, sf_dir))


# --- request metrics ------------------------------------------------------------------------

@query("request_counts", f"""
    SELECT method, endpoint, status, count(*) AS requests FROM ({REQUEST_LOG_SQL}) r GROUP BY ALL
""")
def _request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_counts(request_log(spark, sf_dir))


@query("request_metrics", f"""
    SELECT endpoint, le::varchar AS le, count(*) FILTER (latency <= le) AS requests,
           round(sum(latency), 4) AS latency_sum
    FROM ({REQUEST_LOG_SQL}) r, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5,
        0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 'inf'::double]::double[]) AS le) b
    GROUP BY endpoint, le
""")
def _request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latency_histogram(request_log(spark, sf_dir)).select(
        "endpoint", F.lower(F.regexp_replace(F.col("le").cast("string"), "Infinity", "inf"))
        .alias("le"), "requests", F.round("latency_sum", 4).alias("latency_sum"))


@query("append_audit", f"""
    SELECT id, tenant_id, session_id, recommendation_id, query_text, created_at, scenario_label
    FROM ({AUDIT_LOG_SQL}) a
""")
def _append_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the trail, then all of it, then all of it once more: each record once."""
    path, records = shared_folder(spark, "audit-trail"), materialize(audit_log(spark, sf_dir), "audit")
    append_audit(records.filter(F.crc32(F.col("id").cast("binary")) % 2 == 0), path)
    append_audit(records, path)
    append_audit(records, path)
    return spark.read.schema(records.schema).parquet(path).select(
        "id", "tenant_id", "session_id", "recommendation_id", "query_text", "created_at", "scenario_label")
