"""Column profiles that stay exact and bounded in memory at any row count."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from premia.session import materialize

_SKETCH_ACCURACY = 1_000
_QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
# Cells a bracket is cut into in each round of the search for quartiles, ...
CELLS = 32
# ... and the number of distinct values that are put in order at the end.
LAST_CELL = 65_536


def _clean(field: T.StructField) -> Column:
    """The column with NaN read as missing, as the profile treats it."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def numeric_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, fields: list[T.StructField], as_type: str) -> DataFrame:
    """(column_name, value) rows without missing values."""
    wide = df.select(*[_clean(f).cast(as_type).alias(f.name) for f in fields])
    return (
        wide.unpivot([], [F.col(f"`{c}`") for c in wide.columns], "column_name", "value")
        .filter(F.col("value").isNotNull())
    )


def _summaries(df: DataFrame, approx: bool) -> list[dict]:
    """Per-column figures from a single pass over the wide table; one row reaches the driver."""
    numeric = {f.name for f in numeric_fields(df)}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema.fields):
        value = _clean(field)
        aggregates.append(F.count(value).alias(f"n{i}"))
        if approx:
            aggregates.append(F.approx_count_distinct(value, 0.02).alias(f"u{i}"))
        if field.name in numeric:
            number = value.cast("double")
            aggregates += [
                F.avg(number).alias(f"a{i}"), F.stddev_samp(number).alias(f"s{i}"),
                F.min(number).alias(f"l{i}"), F.max(number).alias(f"h{i}"),
            ]
            if approx:
                aggregates.append(F.percentile_approx(
                    number, list(_QUARTILES.values()), _SKETCH_ACCURACY).alias(f"q{i}"))
    row = df.agg(*aggregates).first().asDict()
    return [
        {
            "column_name": field.name, "position": i, "dtype": field.dataType.simpleString(),
            "row_count": row["rows"], "value_count": row[f"n{i}"],
            "approx_unique": row.get(f"u{i}"), "mean": row.get(f"a{i}"), "std": row.get(f"s{i}"),
            "min": row.get(f"l{i}"), "max": row.get(f"h{i}"), "marks": row.get(f"q{i}"),
        }
        for i, field in enumerate(df.schema.fields)
    ]


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows per column of the profiled table; broadcast, since only the schema bounds it."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _value_counts(df: DataFrame, numbers: list[T.StructField], wide: set[str]) -> DataFrame:
    """Every distinct value of every column once, with its count; counted map-side first.

    Numbers go by ``value``, all others and the numbers too wide for a double by ``text``;
    ``tells`` marks the rows that stand for distinct values of their column.
    """
    def counted(fields: list[T.StructField], as_type: str) -> DataFrame:
        return _long(df, fields, as_type).groupBy("column_name", "value").agg(
            F.count(F.lit(1)).alias("n"))

    as_text = [f for f in df.schema.fields if f not in numbers or f.name in wide]
    parts = []
    if numbers:
        parts.append(counted(numbers, "double").select(
            "column_name", "value", F.lit(None).cast("string").alias("text"), "n",
            (~F.col("column_name").isin(*wide) if wide else F.lit(True)).alias("tells")))
    if as_text:
        parts.append(counted(as_text, "string").select(
            "column_name", F.lit(None).cast("double").alias("value"),
            F.col("value").alias("text"), "n", F.lit(True).alias("tells")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass
class _Wanted:
    """A quartile being searched: its values lie in (low, high], under which lie ``before`` rows; None is no bound."""

    column: str
    quartile: str
    rank: float
    low: float | None = None
    high: float | None = None
    before: int = 0

    @property
    def bracket(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high


_BRACKET = ["column_name", "low", "high"]
_BRACKET_SCHEMA = "column_name string, low double, high double"


def _inside(counts: DataFrame, brackets: DataFrame) -> DataFrame:
    return counts.filter(F.col("value").isNotNull()).join(brackets, "column_name").filter(
        (F.col("low").isNull() | (F.col("value") > F.col("low")))
        & (F.col("high").isNull() | (F.col("value") <= F.col("high"))))


def _narrow(wanted: list[_Wanted], splits: dict[tuple, list[float]], cells: dict[tuple, dict[int, int]]) -> None:
    """Each quartile's bracket becomes the cell or cells that hold the two ranks around it."""
    for w in wanted:
        edges = splits.get(w.bracket)
        if edges is None:
            continue
        counted, end, held = cells[w.bracket], w.before, []
        for cell in sorted(counted):
            start, end = end, end + counted[cell]
            if start <= math.ceil(w.rank) and end > math.floor(w.rank):
                held.append((cell, start))
        (first, start), (last, _) = held[0], held[-1]
        w.low, w.before = (edges[first - 1] if first else w.low), start
        w.high = edges[last] if last < len(edges) else w.high


def _exact_quartiles(counts: DataFrame, summaries: list[dict]) -> DataFrame:
    """Quartiles by linear interpolation, found by counting instead of by holding all values.

    All columns are searched at once, whatever their size. Each round cuts the brackets that still hold many
    distinct values at quantiles of these values and counts rows by cell; only the cells that hold the ranks
    around a quartile go on, so a round leaves a small share of the distinct values. At most ``LAST_CELL`` of
    them are put in order at the end. The driver sees ``CELLS`` numbers a bracket.
    """
    spark = counts.sparkSession
    wanted = [_Wanted(s["column_name"], name, p * (s["value_count"] - 1))
              for s in summaries if s["value_count"] and s["mean"] is not None
              for name, p in _QUARTILES.items()]
    open_ = {w.bracket for w in wanted}
    while open_:
        seen = _inside(counts, _local(spark, list(open_), _BRACKET_SCHEMA)).groupBy(*_BRACKET).agg(
            F.count(F.lit(1)).alias("distinct"),
            F.percentile_approx("value", [i / CELLS for i in range(1, CELLS)]).alias("edges")).collect()
        splits = {(r["column_name"], r["low"], r["high"]): sorted(set(r["edges"]))
                  for r in seen if r["distinct"] > LAST_CELL}
        if not splits:
            break
        cut = _local(spark, [(*bracket, edges) for bracket, edges in splits.items()],
                     f"{_BRACKET_SCHEMA}, edges array<double>")
        cell = F.size(F.filter("edges", lambda edge: edge < F.col("value"))).alias("cell")
        cells: dict[tuple, dict[int, int]] = {}
        for r in _inside(counts, cut).groupBy(*_BRACKET, cell).agg(F.sum("n").alias("n")).collect():
            cells.setdefault((r["column_name"], r["low"], r["high"]), {})[r["cell"]] = r["n"]
        _narrow(wanted, splits, cells)
        open_ = {w.bracket for w in wanted if w.bracket not in {
            (r["column_name"], r["low"], r["high"]) for r in seen if r["distinct"] <= LAST_CELL}}
    key = ["column_name", "quartile"]
    brackets = _local(
        spark, [(w.column, w.low, w.high, w.quartile, w.rank, w.before) for w in wanted],
        f"{_BRACKET_SCHEMA}, quartile string, rank double, before bigint")
    upto = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _inside(counts, brackets).withColumn("end", F.col("before") + F.sum("n").over(upto)) \
        .withColumn("start", F.col("end") - F.col("n"))
    first, last = F.floor("rank"), F.ceil("rank")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (F.col("end") > rank), F.col("value")))

    return (
        ranked.groupBy(*key, "rank").agg(at(first).alias("a"), at(last).alias("b"))
        .select(*key, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - first))
                .alias("value"))
    )


def _fences(quartiles: dict[str, dict[str, float]]) -> list[tuple[str, float, float]]:
    """p25 - 1.5 IQR and p75 + 1.5 IQR of each column."""
    return [(c, q["p25"] - 1.5 * (q["p75"] - q["p25"]), q["p75"] + 1.5 * (q["p75"] - q["p25"]))
            for c, q in quartiles.items()]


def profile_columns(df: DataFrame, approx: bool = False, digits: int = 4) -> DataFrame:
    """One row per column: counts, nulls, distinct values, moments, quartiles, outliers.

    Exact by default: one pass for the moments, one that counts distinct values and writes the
    counts to the shared folder; distinct counts, quartiles and outliers all read those. With
    ``approx`` distinct counts and quartiles come from sketches and no value is shuffled.
    What reaches the driver is a few numbers per column.
    """
    spark = df.sparkSession
    summaries = _summaries(df, approx)
    numbers = numeric_fields(df)
    if approx:
        quartiles = {s["column_name"]: dict(zip(_QUARTILES, map(float, s["marks"])))
                     for s in summaries if s["marks"]}
        counts = _long(df, numbers, "double").withColumn("n", F.lit(1)) if numbers else None
        unique = F.lit(None).cast("bigint")
    else:
        whole = {f.name for f in numbers
                 if not isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        # doubles tell apart whole numbers up to 2**53 and decimals of 15 digits
        wide = {s["column_name"] for s in summaries if s["column_name"] in whole
                and s["max"] is not None and max(abs(s["min"]), abs(s["max"])) >= 2**53}
        wide |= {f.name for f in numbers if isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 15}
        counts = materialize(_value_counts(df, numbers, wide), "value-counts")
        quartiles = {}
        if numbers:
            for row in _exact_quartiles(counts, summaries).collect():
                quartiles.setdefault(row["column_name"], {})[row["quartile"]] = row["value"]
        unique = F.count_if("tells")
    local = _local(
        spark,
        [(s["column_name"], s["position"], s["dtype"], s["row_count"], s["value_count"],
          s["approx_unique"], s["mean"], s["std"], s["min"], s["max"],
          *(quartiles.get(s["column_name"], {}).get(q) for q in _QUARTILES)) for s in summaries],
        "column_name string, position int, dtype string, row_count bigint, value_count bigint, "
        "approx_unique bigint, mean double, std double, min double, max double, p25 double, "
        "p50 double, p75 double")
    if counts is not None:
        fences = _local(spark, _fences(quartiles), "column_name string, low double, high double")
        outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
        counted = counts.join(fences, "column_name", "left").groupBy("column_name").agg(
            unique.alias("unique") if not approx else F.max(unique).alias("unique"),
            F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outliers"))
        local = local.join(counted, "column_name", "left")
    else:
        local = local.withColumn("unique", unique).withColumn("outliers", unique)
    nulls = F.col("row_count") - F.col("value_count")
    return local.select(
        "column_name", "position", "dtype", "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        nulls.alias("null_count"),
        F.when(F.col("row_count") > 0, F.round(nulls / F.col("row_count") * 100, 2))
        .otherwise(0.0).alias("null_pct"),
        F.coalesce("unique", "approx_unique", F.lit(0)).cast("bigint").alias("unique_count"),
        *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "max", *_QUARTILES)],
        F.when(F.col("p25").isNotNull(), F.col("outliers")).alias("outlier_count"),
    )


def column_facts(df: DataFrame, table_name: str) -> DataFrame:
    """What ``schema_context`` needs of a table: table_name, column_name, position, dtype, row_count.

    One count, which reads no column; for figures on values see ``profile_columns``.
    """
    columns = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                 F.lit(f.dataType.simpleString()).alias("dtype")) for i, f in enumerate(df.schema)])
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table_name).alias("table_name"), F.inline(columns), "row_count")


def sample_values(df: DataFrame, order_by: str, columns: list[str] | None = None,
                  n: int = 5) -> DataFrame:
    """The first ``n`` distinct values of each text column, by first appearance along ``order_by``.

    Values are reduced to one row each before they are ranked, and the rank limit prunes in
    every task before the shuffle.
    """
    names = columns or [f.name for f in df.schema.fields
                        if isinstance(f.dataType, T.StringType) and f.name != order_by]
    first = (
        df.select(F.col(order_by).alias("_order"), *names)
        .unpivot(["_order"], names, "column_name", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.min("_order").alias("first_seen"))
    )
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("first_seen", "value"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= n) \
        .select("column_name", "rank", "value")
