"""Queries over policy tables: segments and governed SELECTs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from premia.operators.governed_sql import run_governed_select, run_sql_log
from premia.operators.segments import segment_summary
from premia.plans.registry import query
from premia.plans.tables import POLICY_BOOK_SQL, policy_book, table


def _governed(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    result = run_governed_select(spark, sql, tables, evaluate=False)
    if result.error:
        raise ValueError(result.error)
    return result.frame


@query("segment_summary", f"""
    SELECT region, count(*) AS n, round(avg(claim_frequency), 4) AS mean_claim_frequency,
           round(avg(premium), 4) AS mean_premium
    FROM ({POLICY_BOOK_SQL}) book WHERE age < 25 GROUP BY region
""")
def _segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_summary(
        policy_book(spark, sf_dir), ["region"], ["claim_frequency", "premium"],
        where=F.col("age") < 25,
    )


@query("governed_order_by_aggregate", f"""
    SELECT region, vehicle_type, round(avg(premium), 4) AS avg_premium
    FROM ({POLICY_BOOK_SQL}) book WHERE age < 25 GROUP BY region, vehicle_type
""")
def _governed_order_by_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = """Here is the query:
```sql
SELECT region, vehicle_type, round(avg(premium), 4) AS avg_premium
FROM t_book0001_policies WHERE age < 25
GROUP BY region, vehicle_type ORDER BY avg_premium DESC;
```
It averages premiums."""
    return _governed(spark, reply, {"t_book0001_policies": policy_book(spark, sf_dir)})


@query("governed_filter", f"""
    SELECT policy_id, age, premium FROM ({POLICY_BOOK_SQL}) book
    WHERE age < 5 AND region = 'ASIA' AND claim_count > 0 AND premium > 95000
    ORDER BY premium DESC, policy_id, age LIMIT 500
""")
def _governed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(
        spark,
        "SELECT policy_id, age, premium FROM t_book0001_policies WHERE age < 5 AND region = 'ASIA' "
        "AND claim_count > 0 AND premium > 95000 ORDER BY premium DESC, policy_id, age",
        {"t_book0001_policies": policy_book(spark, sf_dir)},
    )


@query("governed_join", """
    SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def _governed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(
        spark,
        "SELECT c.c_mktsegment AS segment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total "
        "FROM t_book0001_orders o JOIN t_book0001_customers c ON o.o_custkey = c.c_custkey "
        "GROUP BY c.c_mktsegment",
        {"t_book0001_orders": table(spark, sf_dir, "orders"),
         "t_book0001_customers": table(spark, sf_dir, "customer")},
    )


@query("governed_semi_join", """
    SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'
                         AND l_quantity > 40 AND l_discount < 0.05)
    GROUP BY o_orderpriority
""")
def _governed_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(
        spark,
        "SELECT o_orderpriority, count(*) AS n FROM t_book0001_orders WHERE o_orderkey IN "
        "(SELECT l_orderkey FROM t_book0001_items WHERE l_returnflag = 'R' AND l_quantity > 40 "
        "AND l_discount < 0.05) GROUP BY o_orderpriority",
        {"t_book0001_orders": table(spark, sf_dir, "orders"),
         "t_book0001_items": table(spark, sf_dir, "lineitem")},
    )


@query("governed_union_subquery", """
    SELECT nationkey, count(*) AS n FROM (
        SELECT c_nationkey AS nationkey, c_name AS name FROM customer
        UNION SELECT s_nationkey, s_name FROM supplier) q
    GROUP BY nationkey
""")
def _governed_union_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(
        spark,
        "SELECT nationkey, count(*) AS n FROM (SELECT c_nationkey AS nationkey, c_name AS name "
        "FROM t_book0001_customers UNION SELECT s_nationkey, s_name FROM t_book0001_suppliers) q "
        "GROUP BY nationkey",
        {"t_book0001_customers": table(spark, sf_dir, "customer"),
         "t_book0001_suppliers": table(spark, sf_dir, "supplier")},
    )


@query("row_cap", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500
""")
def _row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(
        spark,
        "SELECT o_orderkey, o_totalprice FROM t_book0001_orders "
        "ORDER BY o_totalprice DESC, o_orderkey",
        {"t_book0001_orders": table(spark, sf_dir, "orders")},
    )


# --- a log of statements, run -----------------------------------------------------------

def region_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The customers of each region as a tenant's table."""
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return {f"t_region{r}_customers": customers.filter(F.col("n_regionkey") == r).select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment") for r in range(5)}


def region_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as askers: a count, a foreign table, a division by zero, a first page, a DROP."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    own = F.concat(F.lit("t_region"), region, F.lit("_customers"))
    other = F.concat(F.lit("t_region"), (region + 1) % 5, F.lit("_customers"))
    shapes = [
        F.concat(F.lit("SELECT c_mktsegment, count(*) AS n FROM "), own, F.lit(" WHERE c_nationkey = "), key,
                 F.lit(" GROUP BY c_mktsegment ORDER BY c_mktsegment")),
        F.concat(F.lit("SELECT c_name FROM "), own, F.lit(" limit, "), other),
        F.concat(F.lit("SELECT c_custkey / (c_nationkey - c_nationkey) AS x FROM "), own),
        F.concat(F.lit("Here: ```sql SELECT c_custkey, c_name, nullif(c_nationkey, c_nationkey) AS nothing FROM "), own,
                 F.lit(" ORDER BY c_custkey DESC LIMIT 3;``` Done")),
        F.concat(F.lit("DROP TABLE "), own),
    ]
    return table(spark, sf_dir, "nation").select(
        key.alias("statement_id"), F.concat(F.lit("region"), region).alias("tenant_id"),
        F.element_at(F.array(*shapes), (key % 5 + 1).cast("int")).alias("sql_text"))


@query("run_sql_log", """
    WITH log AS (SELECT n_nationkey AS k, n_regionkey AS r, n_nationkey % 5 AS shape, 't_region' || n_regionkey || '_customers' AS own,
                        't_region' || ((n_regionkey + 1) % 5) || '_customers' AS other FROM nation),
    book AS (SELECT c.*, n_regionkey AS r FROM customer c JOIN nation ON c_nationkey = n_nationkey),
    counted AS (SELECT c_nationkey AS k, string_agg('{"c_mktsegment":"' || c_mktsegment || '","n":' || n || '}', ',' ORDER BY c_mktsegment) AS rows_json,
                       count(*) AS row_count
                FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) s GROUP BY c_nationkey),
    listed AS (SELECT r, string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","nothing":null}', ',' ORDER BY c_custkey DESC) AS rows_json,
                      count(*) AS row_count
               FROM (SELECT * FROM book QUALIFY row_number() OVER (PARTITION BY r ORDER BY c_custkey DESC) <= 3) s GROUP BY r)
    SELECT log.k AS statement_id, 'region' || log.r AS tenant_id,
           CASE shape WHEN 0 THEN 'SELECT c_mktsegment, count(*) AS n FROM ' || own || ' WHERE c_nationkey = ' || log.k || ' GROUP BY c_mktsegment ORDER BY c_mktsegment'
               WHEN 1 THEN 'SELECT c_name FROM ' || own || ' limit, ' || other
               WHEN 2 THEN 'SELECT c_custkey / (c_nationkey - c_nationkey) AS x FROM ' || own
               WHEN 3 THEN 'SELECT c_custkey, c_name, nullif(c_nationkey, c_nationkey) AS nothing FROM ' || own || ' ORDER BY c_custkey DESC LIMIT 3'
               ELSE 'DROP TABLE ' || own END AS sql,
           CASE shape WHEN 0 THEN coalesce(c.rows_json, '') WHEN 3 THEN coalesce(l.rows_json, '') ELSE '' END AS rows_json,
           CASE shape WHEN 0 THEN coalesce(c.row_count, 0) WHEN 3 THEN coalesce(l.row_count, 0) ELSE 0 END AS row_count,
           CASE WHEN shape = 1 THEN 'table_not_entitled' WHEN shape = 2 AND l.r IS NOT NULL THEN 'DIVIDE_BY_ZERO'
                WHEN shape = 4 THEN 'not_a_select' END AS error
    FROM log LEFT JOIN counted c ON c.k = log.k LEFT JOIN listed l ON l.r = log.r
""")
def _run_sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = region_tables(spark, sf_dir)
    entitlements = spark.createDataFrame([(name.split("_")[1], name) for name in tables], "tenant_id string, table_name string")
    return run_sql_log(region_log(spark, sf_dir), entitlements, tables).withColumn(
        "rows_json", F.array_join("rows_json", ","))
