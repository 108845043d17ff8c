"""The log screen against Spark's parser: planted statements and seeded ones."""

import random

import pytest

from premia.operators.governed_sql import judge_statement, run_governed_select, run_sql_log, screen_sql_log, screen_statement

OWN, OTHER, SECRET = "own", "mine", "secret"

LEAKS = [
    "SELECT * FROM own limit, secret", "SELECT * FROM own having, secret", "SELECT * FROM own window, secret",
    "SELECT * FROM own offset, secret", "SELECT * FROM own fetch JOIN secret", "SELECT * FROM own where, secret",
    "SELECT * FROM own `where`, secret", 'SELECT * FROM own "order", secret', "SELECT * FROM own `group` JOIN secret",
    "SELECT * FROM own WHERE a IN (FROM secret)", "SELECT a FROM own /* /* */ ' */ , secret /* ' */",
    "SELECT * FROM own WHERE EXISTS (FROM secret)", "SELECT * FROM own select, secret", "SELECT * FROM own from, secret",
    "SELECT * FROM (own), secret", "SELECT * FROM (own JOIN secret)", "SELECT * FROM ((secret)) q", "SELECT * FROM own group, secret",
    "SELECT * FROM own AS order, secret", "SELECT a FROM own -- x\\\r, secret",
    "SELECT a, (SELECT max(a) FROM secret) FROM own", "SELECT extract(YEAR FROM a), (SELECT 1 FROM secret) FROM own",
    "SELECT is DISTINCT FROM secret", "SELECT a FROM own WHERE a = 1, secret", "SELECT a FROM own MINUS SELECT a FROM secret",
    "SELECT * FROM own CROSS JOIN LATERAL (SELECT * FROM secret)", "SELECT * FROM (SELECT * FROM own UNION ALL FROM secret) q",
    "SELECT * FROM own WHERE a IN (WITH own AS (SELECT * FROM secret) SELECT a FROM own)", "SELECT * FROM own, ${secret}",
    "SELECT `reflect`('java.lang.System', 'getProperty', 'x') FROM own", "SELECT /*+ MERGE(own) */ * FROM secret",
    "SELECT * FROM stream secret", "SELECT * FROM own JOIN `se" + "cret` USING (a)", "SELECT '\\\\' FROM secret WHERE a = ''",
    "SELECT * FROM own a LEFT JOIN own b ON a.a = b.a, secret", "SELECT * FROM own ORDER BY a, (SELECT 1 FROM secret)",
    "SELECT * FROM own PIVOT (sum(a) FOR b IN (1, 2)), secret", "SELECT * FROM own TABLESAMPLE (3 ROWS), secret",
    'SELECT "a" FROM "own""x", own', "SELECT a FROM own /* open", "SELECT a FROM own WHERE b = 'open",
]
HARMLESS = [
    "SELECT a FROM own -- the comment goes on\\\n, secret\n, own",
    "SELECT a FROM own /* one /* two ' */ three */ WHERE b = 'x'", "SELECT 'FROM secret' AS x, \"b\" FROM own -- FROM secret",
    "SELECT a, b FROM own GROUP BY a, b HAVING count(*) > 1 ORDER BY a, b LIMIT 3", "SELECT * FROM own x, mine y WHERE x.a = y.a",
    "SELECT a FROM own WHERE a IN (1, 2) AND b LIKE '%, secret%' ORDER BY 1", "SELECT sum(a) OVER (PARTITION BY a, b ORDER BY b) FROM own",
    "SELECT * FROM (VALUES (1, 2), (3, 4)) t", "SELECT trim(BOTH 'x' FROM b) AS t, substring(b FROM 2) AS s FROM own",
    "SELECT * FROM (own x JOIN mine y ON x.a = y.a)", "SELECT count(*) FROM own /**/ WHERE a BETWEEN 1 AND 2",
    "SELECT * FROM own o JOIN LATERAL (SELECT o.a AS z) q", "SELECT map(a, b), array(1, 2) FROM own", "SELECT a FROM own AS `limit`",
    "SELECT a FROM (SELECT a, b FROM own UNION (SELECT a, b FROM mine)) q", "SELECT CASE WHEN a > 1 THEN 'it''s' ELSE b END FROM own",
]


def seeded(rng):
    """A statement put together from parts; about a third of the tables are someone else's."""
    table = lambda: rng.choice([OWN, OTHER, OWN, "`own`", '"mine"', SECRET, "OWN"])
    alias = lambda: rng.choice(["", "", " x", " AS y", " `from`", ' "join"', " limit", " window"])
    gap = lambda: rng.choice([" ", "\n", " /* , secret */ ", " -- ' secret\n", " /* /* FROM */ */ "])

    def source(depth):
        kind = rng.random()
        if kind < 0.2 and depth:
            return f"({query(depth - 1)}) q{rng.randrange(99)}"
        if kind < 0.3 and depth:
            return f"({query(depth - 1)} UNION{gap()}ALL {query(depth - 1)}) q{rng.randrange(99)}"
        return table() + alias()

    def value(depth):
        return rng.choice(["a", "1", "'x, secret'", "'it''s'", "\"b\"", "extract(YEAR FROM a)", "coalesce(a, b)",
                           f"(SELECT max(a) FROM {table()})" if depth else "b"])

    def query(depth):
        text = f"SELECT{gap()}{', '.join(value(depth) for _ in range(rng.randint(1, 3)))}{gap()}FROM {source(depth)}"
        for _ in range(rng.randrange(3)):
            text += rng.choice([f", {source(depth)}", f"{gap()}JOIN {source(depth)}", f" LEFT JOIN {source(depth)} ON true"])
        if rng.random() < 0.5:
            text += f"{gap()}WHERE {value(depth)} = {value(depth)}"
            if depth and rng.random() < 0.5:
                text += f" AND a IN ({query(depth - 1)})"
        if rng.random() < 0.3:
            text += f" GROUP BY a, b{gap()}HAVING count(*) > 1"
        if rng.random() < 0.3:
            text += f"{gap()}ORDER BY a, b DESC"
        return text + rng.choice(["", "", " LIMIT 5"])

    return query(2) + rng.choice(["", "", "", f" UNION {query(0)}", ";", "; DROP TABLE own"])


def verdicts(spark, statements):
    log = spark.createDataFrame(list(enumerate(statements)), "statement_id int, sql_text string").selectExpr("*", "'t' AS tenant_id")
    entitled = spark.createDataFrame([("t", OWN), ("t", OTHER), ("u", SECRET)], "tenant_id string, table_name string")
    return {r["statement_id"]: r for r in screen_sql_log(log, entitled).collect()}


def test_no_planted_statement_gets_through(spark):
    got = verdicts(spark, LEAKS)
    assert [s for i, s in enumerate(LEAKS) if got[i]["ok"]] == []


def test_harmless_statements_pass(spark):
    got = verdicts(spark, HARMLESS)
    assert [(s, got[i]["reason"]) for i, s in enumerate(HARMLESS) if not got[i]["ok"]] == []
    assert [s for s in HARMLESS if not screen_statement(spark, s, [OWN, OTHER])[0]] == []


def test_seeded_statements_get_the_verdict_of_the_parser(spark):
    rng = random.Random(5)
    statements = [seeded(rng) for _ in range(2000)]
    got = verdicts(spark, statements)
    want = [judge_statement(spark, got[i]["statement"], [OWN, OTHER]) for i in range(len(statements))]
    readable = [i for i, w in enumerate(want) if not w[1].startswith("unreadable")]
    assert len(readable) > 1000 and 200 < sum(want[i][0] for i in readable) < 1800
    assert [(statements[i], got[i]["reason"], want[i][1]) for i in readable if got[i]["ok"] != want[i][0]] == []


@pytest.mark.parametrize("text", ["", None, "   ", ";", "SELECT", "SELECT (", "SELECT )", "'", "/*", "SELECT a FROM"])
def test_odd_replies(spark, text):
    got = verdicts(spark, [text])[0]
    assert got["ok"] == (text in ("SELECT", "SELECT a FROM")) and (got["reason"] is None) == got["ok"]


def test_long_statements(spark):
    wide = "SELECT " + ", ".join(f"c{i}" for i in range(3000)) + " FROM own"
    text = f"SELECT '{'long ' * 20000}' AS x FROM own"
    deep = "SELECT a FROM " + "(SELECT a FROM " * 50 + "secret" + ") q" * 50
    got = verdicts(spark, [wide, text, deep])
    assert [got[i]["ok"] for i in range(3)] == [True, True, False]


def test_run_sql_log(spark):
    own = spark.range(1200).selectExpr("id AS a", "cast(NULL AS string) AS b")
    tables = {"own": own, "mine": own.limit(0), "secret": own}
    texts = ["SELECT a, b FROM own ORDER BY a DESC", "SELECT a, b FROM own ORDER BY a DESC;", "SELECT a / (a - a) AS x FROM own",
             "SELECT nope FROM own", "SELECT * FROM secret", "SELECT a FROM mine", "SELECT a, b AS a FROM own", "DROP TABLE own",
             "SELECT a FROM own WHERE a >", None, "SELECT max(a) AS m FROM own limit, own"]
    log = spark.createDataFrame([(i, "t", s) for i, s in enumerate(texts)], "statement_id int, tenant_id string, sql_text string")
    entitled = spark.createDataFrame([("t", "own"), ("t", "mine"), ("u", "secret")], "tenant_id string, table_name string")
    got = {r["statement_id"]: r for r in run_sql_log(log, entitled, tables, row_cap=3).collect()}
    assert got[0]["rows_json"] == got[1]["rows_json"] == [f'{{"a":{i},"b":null}}' for i in (1199, 1198, 1197)]
    assert [got[i]["row_count"] for i in range(len(texts))] == [3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert got[2]["error"] == "DIVIDE_BY_ZERO" and got[3]["error"].startswith("UNRESOLVED_COLUMN")
    assert [got[i]["error"] for i in (0, 1, 4, 5, 6, 7, 9)] == [
        None, None, "table_not_entitled", None, "duplicate_columns", "not_a_select", "not_a_select"]
    assert got[8]["error"].startswith("unreadable") and got[10]["error"].startswith("AMBIGUOUS")
    assert not any(spark.catalog.tableExists(name) for name in tables)
    none = run_sql_log(log.filter("statement_id = 4"), entitled, tables).collect()
    assert [r["error"] for r in none] == ["table_not_entitled"]
    assert run_sql_log(log.limit(0), entitled, tables).count() == 0


def test_a_failing_statement_ends_in_the_result(spark):
    own = spark.range(10).selectExpr("id AS a")
    assert run_governed_select(spark, "SELECT a / (a - a) AS x FROM own", {"own": own}).error == "DIVIDE_BY_ZERO"
    good = run_governed_select(spark, "SELECT a FROM own ORDER BY a DESC", {"own": own}, row_cap=4)
    assert good.row_count == 4 and [r["a"] for r in good.rows] == [9, 8, 7, 6]
