import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.operators import profile as profiling
from premia.operators.columns import (
    apply_column_tags, drop_all_null_columns, safe_column_names, sanitize_columns,
)
from premia.operators.profile import profile_columns, sample_values
from premia.operators.rowids import with_row_id


def by_column(df):
    return {r["column_name"]: r.asDict() for r in df.collect()}


def test_safe_names():
    assert safe_column_names(["Policy Number", "claim-frequency", "Age.Band", " X "]) == [
        "policy_number", "claim_frequency", "age_band", "x"]
    assert safe_column_names(["a b", "a-b", "A.B"]) == ["a_b", "a_b_2", "a_b_3"]
    long = safe_column_names(["c" * 80, "c" * 80])
    assert [len(n) for n in long] == [63, 63] and long[0] != long[1]


def test_sanitize_drop_and_tags(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "y")], "`A b` int, empty string, C string")
    clean = drop_all_null_columns(sanitize_columns(df))
    assert clean.columns == ["a_b", "c"]
    assert apply_column_tags(clean, {"c": "ignore", "a_b": "target"}).columns == ["a_b"]
    with pytest.raises(ValueError):
        apply_column_tags(clean, {"c": "nonsense"})
    with pytest.raises(ValueError):
        apply_column_tags(clean, {"zzz": "target"})


def test_profile_small(spark):
    df = spark.createDataFrame(
        [(100.0, 25, "North"), (200.0, 30, "South"), (150.0, 22, "North"), (None, 45, "East")],
        "premium double, age int, region string")
    p = by_column(profile_columns(df))
    assert p["premium"]["null_count"] == 1 and p["premium"]["null_pct"] == 25.0
    assert p["premium"]["mean"] == 150.0 and p["premium"]["std"] == 50.0
    assert (p["premium"]["p25"], p["premium"]["p50"], p["premium"]["p75"]) == (125.0, 150.0, 175.0)
    assert p["region"]["unique_count"] == 3 and p["region"]["mean"] is None
    assert p["region"]["outlier_count"] is None and p["age"]["outlier_count"] == 0
    assert {r["row_count"] for r in p.values()} == {4}


def test_profile_outlier_boolean_nan_and_empty(spark):
    df = spark.createDataFrame(
        [(x, True, float("nan")) for x in (1.0, 2.0, 3.0, 4.0, 5.0, 1000.0)],
        "x double, flag boolean, nothing double")
    p = by_column(profile_columns(df))
    assert p["x"]["outlier_count"] == 1
    assert p["flag"]["mean"] is None and p["flag"]["unique_count"] == 1
    assert p["nothing"]["null_count"] == 6 and p["nothing"]["unique_count"] == 0
    empty = by_column(profile_columns(df.filter("x < 0")))
    assert empty["x"]["row_count"] == 0 and empty["x"]["null_pct"] == 0.0


def test_profile_tells_wide_integers_apart(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (big + 2,)], "k bigint")
    assert by_column(profile_columns(df))["k"]["unique_count"] == 3


@pytest.mark.parametrize("last_cell", [65_536, 5])
def test_quartiles_equal_numpy(spark, monkeypatch, last_cell):
    monkeypatch.setattr(profiling, "LAST_CELL", last_cell)
    rng = np.random.default_rng(3)
    n = 30_000
    heavy = np.where(rng.random(n) < 0.34, 7.25, rng.lognormal(3, 2, n))
    steps = rng.integers(0, 5, n).astype(float)
    df = spark.createDataFrame(
        [(float(a), float(b)) for a, b in zip(heavy, steps)], "heavy double, steps double"
    ).repartition(4)
    p = by_column(profile_columns(df, digits=9))
    for name, values in (("heavy", heavy), ("steps", steps)):
        q = np.quantile(values, [0.25, 0.5, 0.75])
        got = [p[name][c] for c in ("p25", "p50", "p75")]
        assert np.allclose(got, q, rtol=0, atol=1e-8)
        low, high = q[0] - 1.5 * (q[2] - q[0]), q[2] + 1.5 * (q[2] - q[0])
        assert p[name]["outlier_count"] == int(((values < low) | (values > high)).sum())
        assert p[name]["unique_count"] == len(np.unique(values))
        assert math.isclose(p[name]["std"], values.std(ddof=1), rel_tol=1e-9)


def test_approximate_profile_is_close(spark):
    df = spark.range(20_000).select((F.col("id") % 1000).cast("double").alias("x"))
    p = by_column(profile_columns(df, approx=True))["x"]
    assert abs(p["unique_count"] - 1000) < 100 and abs(p["p50"] - 499.5) < 25


def test_sample_values_in_order_of_appearance(spark):
    df = spark.createDataFrame(
        [(i, v) for i, v in enumerate("n s n e w x y z".split())] + [(99, None)],
        "pos int, region string")
    rows = sample_values(df, "pos").orderBy("rank").collect()
    assert [r["value"] for r in rows] == ["n", "s", "e", "w", "x"]


def test_row_ids_unique_stable_and_split(spark):
    df = spark.createDataFrame([("a", 1)] * 25 + [("b", 2)] * 3 + [("c", None)], "k string, v int")
    first = with_row_id(df, copies_per_task=10)
    ids = sorted(r["_row_id"] for r in first.collect())
    assert len(ids) == 29 == len(set(ids))
    again = with_row_id(df.repartition(7), copies_per_task=1000)
    assert ids == sorted(r["_row_id"] for r in again.collect())
    assert first.groupBy("k").count().filter("k = 'a'").first()["count"] == 25


def test_profile_tells_long_decimals_apart(spark):
    df = spark.sql("SELECT CAST('1.0000000000000000001' AS decimal(38, 19)) AS d UNION ALL "
                   "SELECT CAST('1.0000000000000000002' AS decimal(38, 19)) UNION ALL SELECT CAST(1 AS decimal(38, 19))")
    assert profile_columns(df).first()["unique_count"] == 3


def test_quartiles_of_odd_columns(spark, monkeypatch):
    """Nine tenths of equal values, huge spans, and a quartile between two far values."""
    monkeypatch.setattr(profiling, "LAST_CELL", 3)
    n = 2_001
    columns = {
        "same": [5.0 if i % 10 else float(i) for i in range(n)],
        "span": [(-1.0) ** i * 10.0 ** (i % 300) for i in range(n)],
        "gap": [float(i) if i < n // 4 + 1 else 1e9 + i for i in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    p = by_column(profile_columns(df.repartition(3), digits=6))
    for name, values in columns.items():
        wanted = np.quantile(values, [0.25, 0.5, 0.75])
        assert np.allclose([p[name][q] for q in ("p25", "p50", "p75")], wanted, rtol=1e-12, atol=1e-6), name
