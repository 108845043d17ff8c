import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from premia.operators.audit import (
    CHUNK_TRACE, SQL_TRACE, append_audit, apply_decisions, audit_kpis, audit_page,
    audit_records, audit_report_lines, audit_trace, export_audit_json,
)
from premia.operators.evidence import (
    assemble_prompts, compare_scenarios, expand_scenarios, format_document_evidence,
    format_sql_evidence,
)
from premia.operators.memory import (
    carry_forward_assets, context_strings, conversation_turns, recent_sessions, recent_window,
    rollup_blocks, session_summaries, sessions,
)
from premia.operators.metrics import latency_histogram, request_counts
from premia.operators.recommendations import (
    RECOMMENDATION_TYPE, explode_recommendations, generate_recommendations, parse_recommendations,
)

T0 = dt.datetime(2025, 5, 24, 10, 0)
LOG = ("query_id int, session_id string, tenant_id string, asked_at timestamp_ntz, "
       "question string, action string, dataset_ids array<string>, document_ids array<string>, "
       "is_ephemeral boolean")


def make_log(spark, n=40, sessions_=("s",)):
    rows = [(i, sessions_[i % len(sessions_)], "t", T0 + dt.timedelta(minutes=40 * i), f"q{i}",
             f"a{i}" * 200, [f"d{i}"] if i % 6 == 0 else [], [], i % 5 == 3) for i in range(n)]
    return spark.createDataFrame(rows, LOG), rows


def simulate(rows, window=4, after=8):
    """The memory rule, one turn at a time: (stored, blocks)."""
    stored, blocks, turn = [], [], 0
    for r in rows:
        if r[8]:
            continue
        stored += [("user", r[4], turn), ("assistant", r[5], turn)]
        turn += 1
        if len(stored) > 2 * after:
            old, stored = stored[:-2 * window], stored[-2 * window:]
            blocks.append("\n".join(f"{a.upper()}: {c[:500]}" for a, c, _ in old))
    return stored, blocks


@pytest.mark.parametrize("n", [3, 9, 10, 11, 40])
def test_memory_equals_turn_by_turn(spark, n):
    log, rows = make_log(spark, n)
    messages = conversation_turns(log)
    stored, blocks = simulate(rows)
    got = [r["old_text"] for r in rollup_blocks(messages).orderBy("block").collect()]
    assert got == blocks
    window = recent_window(messages).orderBy("message_index").collect()
    assert [(r["role"], r["content"], r["turn_index"]) for r in window] == [
        (a, c[:600], t) for a, c, t in stored[-8:]]


def test_context_and_summaries(spark):
    log, rows = make_log(spark, 40)
    messages = conversation_turns(log)
    _, blocks = simulate(rows)
    summaries = session_summaries(
        rollup_blocks(messages), lambda: lambda prompts: [f"S{len(p)}" for p in prompts])
    size = len("Previous summary:\n\n\nNew conversation to summarize:\n")
    summary = None
    for b in blocks:
        summary = f"S{size + len(summary or 'None') + len(b)}"
    assert [(r["session_id"], r["context_summary"]) for r in summaries.collect()] == [("s", summary)]
    context = context_strings(recent_window(messages), summaries).first()["context"]
    assert context.startswith(f"Summary of earlier discussion:\n{summary}\n\nRecent conversation:\n")
    plain = context_strings(recent_window(messages)).first()["context"]
    assert plain.startswith("Recent conversation:\nUSER: q")
    assert session_summaries(rollup_blocks(messages).limit(0), lambda: list).count() == 0


def test_summaries_over_batches(spark):
    """Sessions of 1 to 40 blocks, cut into Arrow batches of 7 rows, one session known by null."""
    rows = [(s if s else None, b, f"{s}.{b}") for s in range(12) for b in range(1 + 3 * s + (s == 11) * 6)]
    blocks = spark.createDataFrame(rows, "session_id int, block bigint, old_text string").orderBy(F.rand(1)).coalesce(3)

    def load():
        def model(prompts):
            said = [p.split("\n\nNew conversation to summarize:\n") for p in prompts]
            return [earlier.removeprefix("Previous summary:\n").replace("None", "") + "," + new for earlier, new in said]
        return model

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["session_id"]: r["context_summary"] for r in session_summaries(blocks, load).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = {}
    for s, b, text in sorted(rows, key=lambda r: r[1]):
        wanted[s] = wanted.get(s, "") + "," + text
    assert got == wanted


def test_tenants_may_share_a_session_id(spark):
    log, _ = make_log(spark, 40)
    other = log.withColumn("tenant_id", F.lit("other"))
    both = log.unionByName(other.withColumn("dataset_ids", F.array().cast("array<string>")))
    turns = conversation_turns(both)
    alone = conversation_turns(log).count()
    assert {r["tenant_id"]: r["count"] for r in turns.groupBy("tenant_id").count().collect()} == {
        t: alone for t in {"other", log.first()["tenant_id"]}}
    assert rollup_blocks(turns).groupBy("tenant_id", "block").count().filter("count > 1").isEmpty()
    assert recent_window(turns).count() == 2 * recent_window(conversation_turns(log)).count()
    assert context_strings(recent_window(turns)).count() == 2
    theirs = carry_forward_assets(both).filter("tenant_id = 'other'")
    assert theirs.filter("size(effective_dataset_ids) > 0").isEmpty()


def test_ephemeral_runs_leave_no_memory(spark):
    log, rows = make_log(spark, 12)
    ephemeral = {r[0] for r in rows if r[8]}
    said = {r["content"] for r in conversation_turns(log).collect()}
    assert not said & {f"q{i}" for i in ephemeral}
    all_ephemeral = log.withColumn("is_ephemeral", F.lit(True))
    assert conversation_turns(all_ephemeral).count() == 0
    row = sessions(all_ephemeral).first()
    assert row["turn_count"] == 0 and row["active_dataset_ids"] == []
    assert row["last_active_at"] == rows[-1][3]


def test_carry_forward_and_sessions(spark):
    log, rows = make_log(spark, 40, ("s", "u"))
    got = {r["query_id"]: r["effective_dataset_ids"] for r in carry_forward_assets(log).collect()}
    active = {}
    for r in rows:
        assert got[r[0]] == (r[6] or active.get(r[1], []))
        if not r[8] and r[6]:
            active[r[1]] = r[6]
    table = {r["session_id"]: r for r in sessions(log).collect()}
    assert {s: table[s]["active_dataset_ids"] for s in active} == active
    assert [r["session_id"] for r in recent_sessions(sessions(log), "t", 1).collect()] == ["u"]


def test_evidence_texts(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b", 7, "second"), (1, 1, "abcdefghij", 5, "first"), (1, 3, None, None, "third")],
        "question_id int, rank int, document_id string, page int, text string")
    text = format_document_evidence(hits).first()["document_evidence"]
    assert text == ("Evidence 1 [Doc abcdefgh, p.5]:\nfirst\n\nEvidence 2 [Doc b, p.7]:\nsecond\n"
                    "\nEvidence 3 [Doc unknown, p.?]:\nthird\n")
    results = spark.createDataFrame(
        [(1, 1, "SELECT 1", [json.dumps({"a": i}) for i in range(7)], 7, None),
         (1, 2, "SELECT x", [], 0, "no x")],
        "question_id int, query_no int, sql string, rows_json array<string>, row_count bigint, "
        "error string")
    text = format_sql_evidence(results).first()["sql_evidence"]
    assert text == ('Query 1:\nSELECT 1\nReturned 7 rows. Sample: [{"a": 0}, {"a": 1}, {"a": 2}, '
                    '{"a": 3}, {"a": 4}]\n\nQuery 2 (FAILED: no x):\nSELECT x\n')


def test_prompts_and_scenarios(spark):
    questions = spark.createDataFrame([(1, "Reprice?", None)],
                                      "question_id int, question string, context string")
    prompt = assemble_prompts(questions).first()["prompt"]
    parts = ["No prior context.", "Reprice?", "No relevant document sections found.",
             "No structured data queries were run."]
    places = [prompt.index(p) for p in parts]
    assert places == sorted(places)
    runs = expand_scenarios(questions, [("Base", {}), ("Stress", {"claims_increase": 0.25})])
    got = {r["scenario_label"]: r["augmented_question"] for r in runs.collect()}
    assert got == {"Base": "Reprice?", "Stress": "Reprice?\nScenario assumptions for this run: "
                   '{"claims_increase": 0.25}'}
    for wrong in ([("one", {})], [(str(i), {}) for i in range(4)]):
        with pytest.raises(ValueError):
            expand_scenarios(questions, wrong)
    results = spark.createDataFrame(
        [(1, "Base", "up", 1), (1, "Stress", "down", 1), (2, "Base", "up", None)],
        "question_id int, scenario_label string, action string, n int")
    table = {r["question_id"]: r for r in
             compare_scenarios(results, ["Base", "Stress"], ["action", "n"]).collect()}
    assert table[1]["action_differs"] and not table[1]["n_differs"]
    assert table[2]["action_differs"] and table[2]["Stress_action"] is None


GOOD = json.dumps({"action": "Raise", "confidence": "high", "conflicts": ["x"],
                   "document_evidence": [{"text": "t", "source": "s", "page": 3}]})


def test_parse_and_explode(spark):
    replies = [(1, GOOD), (2, f"```json\n{GOOD}\n```\nbye"), (3, f"```{GOOD}```"), (4, "no json"),
               (5, '{"action": "x", "confidence": "certain"}'), (6, '{"confidence": "low"}'),
               (7, None), (8, '{"action": "x", "confid'), (9, "[1, 2]"), (10, "```")]
    df = spark.createDataFrame(replies, "id int, raw_model_output string")
    parsed = parse_recommendations(df)
    got = {r["id"]: r["problem"] for r in parsed.collect()}
    assert [got[i] for i in (1, 2, 3)] == [None] * 3
    assert got[4] == got[7] == got[8] == got[9] == got[10] == "invalid_json"
    assert (got[5], got[6]) == ("unknown_confidence", "missing_action")
    assert all((r["recommendation"] is None) != (r["problem"] is None) for r in parsed.collect())
    items = explode_recommendations(parsed.filter("id = 2"), "id").collect()
    assert {(r["section"], r["item"], r["detail"]) for r in items} == {
        ("document_evidence", "t", "s, p.3"), ("conflicts", "x", None)}


def test_generate_asks_again(spark):
    prompts = spark.createDataFrame([(1, "easy"), (2, "hard"), (3, "never")],
                                    "question_id int, prompt string")

    def generate(prompt):
        return F.when(prompt.startswith("easy") | (prompt.startswith("hard")
                      & prompt.contains("valid JSON")), F.lit(GOOD)).otherwise(F.lit("hm"))

    got = {r["question_id"]: r for r in generate_recommendations(prompts, generate).collect()}
    assert got[1]["problem"] is None and got[2]["problem"] is None
    assert got[2]["raw_model_output"] == "hm" and got[2]["recommendation"]["action"] == "Raise"
    assert got[3]["problem"] == "invalid_json" and len(got) == 3


@pytest.fixture(scope="module")
def audit(spark):
    results = spark.createDataFrame(
        [(i, f"t{i % 2}", "s", T0 + dt.timedelta(minutes=i), f"Should we reprice {i}?") for i in
         range(6)],
        "query_id int, tenant_id string, session_id string, asked_at timestamp_ntz, question string")
    return audit_records(results.select(
        "*", F.array(F.lit("ds-1")).alias("dataset_ids"), F.array().cast("array<string>")
        .alias("document_ids"),
        F.array(F.struct(F.lit("SELECT 1" + "x" * 2000), F.lit("[]"), F.lit(0), F.lit(None)))
        .cast(SQL_TRACE).alias("sql_queries"),
        F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.struct(
            F.repeat(F.lit("y"), 500), F.lit("document-9"), i, F.lit("text"), i, F.lit(0.92),
            F.lit(None))).cast(CHUNK_TRACE).alias("retrieved_chunks"),
        F.lit(GOOD).alias("raw_model_output"),
        F.when(F.col("query_id") > 0, F.from_json(F.lit(GOOD), RECOMMENDATION_TYPE))
        .alias("recommendation"),
        F.lit(None).cast("string").alias("scenario_label"),
        F.lit(None).cast("string").alias("scenario_assumptions")), "model", "embedder")


def test_decisions(spark, audit):
    ids = [r["id"] for r in audit.orderBy("created_at").collect()]
    t = [T0 + dt.timedelta(hours=i) for i in range(9)]
    decisions = spark.createDataFrame([
        (1, ids[0], "t0", "approve", None, t[0]), (2, ids[0], "t0", "reject", "  ", t[1]),
        (3, ids[0], "t0", "reject", "too high", t[2]), (4, ids[0], "t0", "accept", None, t[3]),
        (5, ids[1], "t0", "accept", None, t[4]), (6, "zzz", "t0", "accept", None, t[5]),
        (7, ids[1], "t1", "review", None, t[6]), (8, ids[2], "t0", None, None, t[7])],
        "decision_id int, audit_id string, tenant_id string, action string, comment string, "
        "decided_at timestamp_ntz")
    decided, statuses = apply_decisions(audit, decisions)
    assert {r["decision_id"]: r["status"] for r in statuses.collect()} == {
        1: "invalid_action", 2: "comment_required", 3: "recorded", 4: "conflict", 5: "not_found",
        6: "not_found", 7: "recorded", 8: "invalid_action"}
    rows = {r["id"]: r for r in decided.collect()}
    assert (rows[ids[0]]["user_action"], rows[ids[0]]["user_comment"]) == ("reject", "too high")
    assert rows[ids[0]]["action_at"] == t[2] and rows[ids[2]]["user_action"] is None
    later = spark.createDataFrame([(9, ids[0], "t0", "accept", None, t[8])], decisions.schema)
    again, statuses = apply_decisions(decided, later)
    assert statuses.first()["status"] == "conflict"
    assert {r["id"]: r["user_action"] for r in again.collect()}[ids[0]] == "reject"
    kpis = {r["tenant_id"]: tuple(r)[1:] for r in audit_kpis(decided).collect()}
    assert kpis == {"t0": (3, 0, 2), "t1": (3, 0, 2)}


def test_page_trace_and_append(spark, audit, tmp_path):
    page = audit_page(audit, "t1", limit=2, offset=1).collect()
    assert [r["query_text"] for r in page] == ["Should we reprice 3?", "Should we reprice 1?"]
    sql, chunks = audit_trace(audit)
    assert sql.count() == 6 and chunks.count() == 42
    path = str(tmp_path / "audit")
    append_audit(audit.filter("tenant_id = 't0'"), path)
    append_audit(audit.filter("tenant_id = 't1'"), path)
    assert spark.read.parquet(path).count() == 6


def test_export_and_report(audit):
    record = json.loads(export_audit_json(audit, pretty=True).first()["json"])
    assert len(record) == 20 and record["action_at"] is None
    assert record["created_at"].startswith("2025-05-24T10:0") and record["prompt_version"] == "v1.0"
    assert isinstance(record["session_id"], str)
    odd = audit.limit(1).withColumn("scenario_assumptions", F.lit("no json")).withColumn("sql_queries", F.array(F.struct(
        F.lit("SELECT 1").alias("sql"), F.lit('[{"a": 1.5}]').alias("rows_json"), F.lit(1).alias("row_count"),
        F.lit(None).cast("string").alias("error"))))
    record = json.loads(export_audit_json(odd).first()["json"])
    assert record["scenario_assumptions"] == "no json"
    assert record["sql_queries"] == [{"sql": "SELECT 1", "rows": [{"a": 1.5}], "row_count": 1, "error": None}]
    record = json.loads(export_audit_json(odd.withColumn("scenario_assumptions", F.lit('{"x": [1, null]}'))).first()["json"])
    assert record["scenario_assumptions"] == {"x": [1, None]}
    first = audit.orderBy("created_at").limit(2).select("*")
    lines = {}
    for r in audit_report_lines(first).orderBy("id", "line_no").collect():
        lines.setdefault(r["id"], []).append((r["section"], r["text"]))
    without, with_ = sorted(lines.values(), key=lambda v: ("recommendation", "N/A") not in v)
    assert ("recommendation", "Confidence: N/A") in without
    assert ("recommendation", "Raise") in with_ and ("conflicts", "- x") in with_
    assert without[1] == ("title", "Generated: 2025-05-24 10:00 UTC")
    code = [t for s, t in with_ if s == "sql_evidence"]
    assert len(code[0]) == 1000 and code[1] == "Rows returned: 0"
    document = [t for s, t in with_ if s == "document_evidence"]
    assert len(document) == 10 and document[0] == "[Doc document, p.1]" and len(document[1]) == 400
    assert not any(s == "decision" for s, _ in with_)


def test_request_metrics(spark):
    log = spark.createDataFrame(
        [("GET", "/a", 200, x) for x in (0.001, 0.02, 3.0, 99.0)] + [("POST", "/b", 500, 0.5)],
        "method string, endpoint string, status int, latency double")
    assert {tuple(r) for r in request_counts(log).collect()} == {
        ("GET", "/a", 200, 4), ("POST", "/b", 500, 1)}
    got = {(r["endpoint"], r["le"]): r["requests"] for r in latency_histogram(log).collect()}
    assert got["/a", 0.005] == 1 and got["/a", 0.025] == 2 and got["/a", 10.0] == 3
    assert got["/a", float("inf")] == 4 and got["/b", 0.5] == 1 and got["/b", 0.25] == 0


def test_replies_are_read_field_by_field(spark):
    def reply(**fields):
        return json.dumps({"action": "Raise", "confidence": "High ", **fields})

    replies = [
        (1, reply(document_evidence=[{"text": "t", "page": "3"}, {"text": "u", "page": "n/a"}, "loose"])),
        (2, reply(conflicts="none", reasoning_steps=["a", 2, None], uncertainty_sources=None)),
        (3, reply(action=7, extra={"x": [1]}, sql_evidence={"sql": "SELECT 1", "key_finding": 5})),
        (4, '{"action": "x", "action": "y"'), (5, '"just a text"'), (6, reply(confidence=["high"])),
    ]
    got = {r["id"]: r for r in parse_recommendations(
        spark.createDataFrame(replies, "id int, raw_model_output string")).collect()}
    assert [got[i]["problem"] for i in range(1, 7)] == [None, None, None, "invalid_json", "invalid_json", "unknown_confidence"]
    one, two, three = (got[i]["recommendation"] for i in (1, 2, 3))
    assert one["confidence"] == "high" and [(e["text"], e["page"]) for e in one["document_evidence"]] == [
        ("t", 3), ("u", None), ("loose", None)]
    assert two["conflicts"] == ["none"] and two["reasoning_steps"] == ["a", "2", None] and two["uncertainty_sources"] is None
    assert three["action"] == "7" and [(e["sql"], e["key_finding"]) for e in three["sql_evidence"]] == [("SELECT 1", "5")]


def test_only_bad_syntax_is_asked_again(spark):
    prompts = spark.createDataFrame([(1, "p")], "question_id int, prompt string")
    odd = json.dumps({"action": "Raise", "confidence": "HIGH", "conflicts": "none", "document_evidence": [{"page": "x"}]})

    def generate(prompt):
        return F.when(prompt.contains("valid JSON"), F.lit("asked again")).otherwise(F.lit(odd))

    [row] = generate_recommendations(prompts, generate).collect()
    assert row["problem"] is None and row["raw_model_output"] == odd


def test_a_repeated_append_adds_nothing(spark, audit, tmp_path):
    path = str(tmp_path / "trail")
    append_audit(audit.unionByName(audit).filter("tenant_id = 't0'"), path)
    for _ in range(2):
        append_audit(audit, path)
    append_audit(audit.limit(0), path)
    got = spark.read.schema(audit.schema).parquet(path).collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in audit.collect())


def test_appends_store_no_second_copy(spark, audit, tmp_path):
    path = str(tmp_path / "trail")
    stored = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {f.name for f in stored.glob("*")}
    half = audit.filter("tenant_id = 't0'")
    append_audit(half, path)
    files = {f for f in Path(path).rglob("*.parquet")}
    append_audit(half, path)
    assert {f for f in Path(path).rglob("*.parquet")} == files
    append_audit(audit.unionByName(audit), path)  # some known, all twice
    got = spark.read.schema(audit.schema).parquet(path).collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in audit.collect())
    assert {f.name for f in stored.glob("*")} == before
    # an id that is null equals none in the trail
    nameless = half.limit(1).withColumn("id", F.lit(None).cast("string"))
    for n in (1, 2):
        append_audit(nameless.unionByName(half), path)
        assert spark.read.schema(audit.schema).parquet(path).count() == len(got) + n
