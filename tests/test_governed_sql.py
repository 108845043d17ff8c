import pytest
from pyspark.sql import functions as F

from premia.functions.text import normalize_sql
from premia.operators.governed_sql import (
    normalize_statement, run_governed_select, screen_sql_log, screen_statement,
)

OWN, FOREIGN = "t_aaaaaaaa_bbbbbbbb", "t_cccccccc_dddddddd"

ACCEPTED = [
    f"SELECT age, premium FROM {OWN} WHERE region = 'North'",
    f"select * from {OWN.upper()} where age > 25;",
    f"SELECT region, AVG(premium) AS m FROM {OWN} GROUP BY region ORDER BY m DESC",
    f"SELECT * FROM {OWN} WHERE age < 25 AND region = 'North' AND claim_count > 2",
    f"SELECT * FROM (SELECT age FROM {OWN} UNION SELECT age FROM {OWN}) q",
    f"SELECT DISTINCT age FROM {OWN} ORDER BY age LIMIT 3",
    f"SELECT age FROM {OWN} WHERE age IN (SELECT max(age) FROM {OWN})",
    f"SELECT region, count(*) AS n FROM {OWN} GROUP BY region HAVING count(*) > 1",
    f"SELECT age, row_number() OVER (PARTITION BY region ORDER BY age) AS r FROM {OWN}",
    f"INSERT INTO x SELECT age FROM {OWN}",
    f"Sure!\n```sql\nSELECT age FROM {OWN};\n```\nDROP TABLE x",
]
REFUSED = [
    f"INSERT INTO {OWN} VALUES (1)",
    f"DROP TABLE {OWN}",
    f"DELETE FROM {OWN}",
    "SELECT * FROM pg_catalog.pg_tables",
    "SELECT * FROM pg_class",
    "SELECT table_name FROM information_schema.tables",
    f"SELECT * FROM {FOREIGN}",
    f"SELECT a.premium FROM {OWN} a JOIN {FOREIGN} b ON a.age = b.age",
    f"SELECT premium FROM {OWN} UNION SELECT premium FROM {FOREIGN}",
    f"SELECT premium FROM {OWN} UNION ALL SELECT premium FROM {OWN} ORDER BY premium",
    f"SELECT age FROM {OWN} INTERSECT SELECT age FROM {OWN}",
    f"SELECT * FROM {OWN} WHERE age IN (SELECT age FROM {FOREIGN})",
    f"SELECT (SELECT max(age) FROM {FOREIGN}) FROM {OWN}",
    f"SELECT * FROM {OWN} WHERE EXISTS (SELECT 1 FROM {FOREIGN})",
    f"WITH x AS (SELECT * FROM {FOREIGN}) SELECT * FROM x",
    f"SELECT * FROM {OWN} WHERE region = 'a;b'",
    "SELECT * FROM parquet.`/etc/data`",
    "SELECT * FROM range(3)",
    f"SELECT reflect('java.lang.System', 'getProperty', 'x') FROM {OWN}",
    f"SELECT java_method('java.lang.System', 'getProperty', 'x') FROM {OWN}",
    f"SELECT TRANSFORM(age) USING 'cat' FROM {OWN}",
    f"SELECT * FROM IDENTIFIER('{FOREIGN}')",
    f"SELECT age FROM {OWN} |> WHERE age > 1",
    "SELECT (",
    "nothing to see",
    "",
]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(spark, sql):
    ok, reason = screen_statement(spark, sql, [OWN])
    assert ok, reason


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    ok, _ = screen_statement(spark, sql, [OWN])
    assert not ok


def test_long_column_lists_hide_no_table(spark):
    columns = ", ".join(f"a{i}" for i in range(200))
    ok, reason = screen_statement(
        spark, f"SELECT {columns}, (SELECT 1 FROM {FOREIGN}) AS z FROM {OWN}", [OWN])
    assert not ok and FOREIGN in reason


NORMALIZED = [
    ("```sql\n    SELECT a FROM t WHERE r = 'N';\n    ```\n    extra", "SELECT a FROM t WHERE r = 'N';"),
    ("  here: select 1 ; select 2", "select 1 ;"),
    ("preselect x SELECT y", "SELECT y"),
    ("DROP TABLE t; tail", "DROP TABLE t;"),
    ("```SQL\nSelect\n a\n```", "Select\n a"),
    ("", ""),
]


def test_both_normalizers(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(NORMALIZED)], "i int, s string")
    rows = df.select("i", normalize_sql(F.col("s")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [want for _, want in NORMALIZED]
    assert [normalize_statement(raw) for raw, _ in NORMALIZED] == [want for _, want in NORMALIZED]


@pytest.fixture
def policies(spark):
    return spark.range(1200).select(
        F.col("id").alias("age"), (F.col("id") * 2.0).alias("premium"),
        F.when(F.col("id") % 2 == 0, "North").otherwise("South").alias("region"))


def test_run_caps_rows_and_keeps_order(spark, policies):
    result = run_governed_select(spark, f"SELECT age FROM {OWN} ORDER BY age DESC", {OWN: policies})
    ages = [r["age"] for r in result.frame.collect()]
    assert result.error is None and ages == list(range(1199, 699, -1))
    plan = result.frame._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_run_reports_errors(spark, policies):
    for sql in (f"SELECT nope FROM {OWN}", f"SELECT * FROM {FOREIGN}",
                f"SELECT age, premium AS age FROM {OWN}"):
        result = run_governed_select(spark, sql, {OWN: policies})
        assert result.frame is None and result.error


def test_segment_answer_through_sql(spark, policies):
    result = run_governed_select(
        spark, f"SELECT region, avg(premium) AS m FROM {OWN} WHERE age < 25 GROUP BY region "
        "ORDER BY m", {OWN: policies})
    assert [tuple(r) for r in result.frame.collect()] == [("North", 24.0), ("South", 24.0)]


def test_log_screen_agrees_with_the_parser(spark):
    more = [
        f"SELECT * FROM {OWN} a, {FOREIGN} b",
        f"SELECT * FROM {OWN} a, {OWN} b WHERE a.age = b.age",
        f"SELECT * FROM (SELECT age FROM {OWN}) q, {FOREIGN}",
        f"SELECT * FROM (SELECT age FROM {OWN} WHERE age IN (1, 2) UNION SELECT 3) q",
        f"SELECT extract(YEAR FROM day) AS y FROM {OWN}",
        f"SELECT coalesce(age, premium) AS x FROM {OWN} a LEFT JOIN {OWN} b "
        "ON coalesce(a.age, b.age) = b.premium",
        f"SELECT '(' AS x FROM {OWN} UNION SELECT ')' FROM {OWN}",
        f"SELECT 'FROM {FOREIGN}' AS x FROM {OWN}",
        f"SELECT age FROM {OWN}, -- nothing\n {FOREIGN}",
        f"SELECT max(age) AS m FROM {OWN} WHERE age > (SELECT avg(age) FROM {FOREIGN})",
        f"SELECT age FROM {OWN}, -- don't\n {FOREIGN}",
        f"SELECT '\\'' FROM {FOREIGN} WHERE region = 'x'",
        f"SELECT \"'\" AS x FROM {FOREIGN} WHERE region = \"'\"",
        f"SELECT age FROM {OWN} WHERE age IN (TABLE {FOREIGN})",
        f"SELECT reflect('java.lang.System', 'getProperty', 'x') AS x FROM {OWN}",
        f"SELECT age FROM {OWN} -- one\r, {FOREIGN}",
        f"SELECT r'\\' AS x FROM {FOREIGN} WHERE region = 'x' OR region = ''''",
        f'SELECT "age" FROM "{OWN}"',
        f'SELECT age FROM "{FOREIGN}"',
        f"SELECT age FROM `{FOREIGN}`",
        "SELECT age FROM " + "(SELECT age FROM " * 12 + OWN + ") q" * 12,
        "SELECT age FROM " + "(SELECT age FROM " * 12 + FOREIGN + ") q" * 12,
    ]
    shared = [s for s in ACCEPTED + REFUSED[:12] + more if "INSERT INTO x" not in s]
    log = spark.createDataFrame([(i, "t", s) for i, s in enumerate(shared)],
                                "statement_id int, tenant_id string, sql_text string")
    entitled = spark.createDataFrame([("t", OWN), ("u", FOREIGN)],
                                     "tenant_id string, table_name string")
    got = {r["statement_id"]: r["ok"] for r in screen_sql_log(log, entitled).collect()}
    want = {i: screen_statement(spark, s, [OWN])[0] for i, s in enumerate(shared)}
    assert [shared[i] for i in got if got[i] != want[i]] == []


def test_double_quotes_name_columns(spark, policies):
    result = run_governed_select(spark, f'SELECT "region" FROM {OWN} WHERE "age" = 3', {OWN: policies})
    assert [r[0] for r in result.frame.collect()] == ["South"]


def test_no_view_stays(spark, policies):
    run_governed_select(spark, f"SELECT age FROM {OWN}", {OWN: policies})
    assert not spark.catalog.tableExists(OWN)
