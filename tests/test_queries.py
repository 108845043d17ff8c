"""Every registered query against its SQL twin, and the shape of some plans."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from parity import compare, oracle
from premia.session import build_session, shared_folder, spread
from premia.plans.tables import table

SF = os.environ.get("PREMIA_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    build = contract.queries()[name]
    if name in contract.oracle_sql():
        problem = compare(spark, con, name, build, contract.oracle_sql()[name], SF)
        assert problem is None, problem
    else:
        assert build(spark, SF).count() > 0


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry is not None


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(contract.queries()["segment_summary"](spark, SF))
    assert "PushedFilters: [IsNotNull(p_size), LessThan(p_size,25)" in plan
    assert "l_quantity" not in plan and "l_comment" not in plan


@pytest.mark.parametrize("name", [
    "resolve_datasets", "screen_sql_log", "carry_forward", "turns", "decisions",
    "register_assets", "scenario_expand", "chunk_documents", "vector_top_k"])
def test_no_cross_joins(spark, name):
    plan = plan_of(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rank_limits_prune_before_the_shuffle(spark):
    for name in ("recent_window", "sample_values"):
        plan = plan_of(contract.queries()[name](spark, SF))
        assert plan.count("WindowGroupLimit") == 2


def test_chunking_does_not_shuffle(spark):
    from premia.operators.chunking import chunk_text
    assert "Exchange" not in plan_of(chunk_text(table(spark, SF, "documents")))


def test_spread_only_small_inputs(spark):
    few = table(spark, SF, "part")
    assert spread(few, "p_partkey").rdd.getNumPartitions() == 4
    many = spark.range(0, 100, 1, 16).withColumn("x", F.lit(1))
    assert "Exchange" not in plan_of(spread(many, "id"))


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(base)
    assert build_session("again").conf.get("spark.sql.session.timeZone") == "UTC"
