"""Segment aggregates over a policy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def segment_summary(
    df: DataFrame, by: list[str], metrics: list[str], where: Column | None = None, digits: int = 4
) -> DataFrame:
    """Filter, group by segment columns, count rows and average each metric."""
    scoped = df if where is None else df.filter(where)
    return scoped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(m), digits).alias(f"mean_{m}") for m in metrics],
    )
