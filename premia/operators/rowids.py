"""A stable row id without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COPIES_PER_TASK = 1_000_000
# Timestamps to the microsecond, or rows that differ there would share an id.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
          "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _numbered(copies: DataFrame, first: Column, last: Column, columns: list[str]) -> DataFrame:
    return copies.select(*columns, "_digest", F.explode(F.sequence(first, last)).alias("_ordinal"))


def with_row_id(df: DataFrame, name: str = "_row_id",
                copies_per_task: int = COPIES_PER_TASK) -> DataFrame:
    """Add ``<digest of the row>-<n>``, n counting from 0 among equal rows.

    Equal rows are interchangeable, so they are counted with map-side partial counts and written
    out again from the count. A row with very many copies is spread over tasks in blocks of
    ``copies_per_task``, so no task ever holds a group of copies.
    """
    columns = [f"`{c}`" for c in df.columns]
    digest = F.sha2(F.to_json(F.struct(*columns), _EXACT), 256)
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")) \
        .withColumn("_digest", digest)
    top = F.col("_copies") - 1
    few = _numbered(counted.filter(F.col("_copies") <= copies_per_task),
                    F.lit(0).cast("bigint"), top, columns)
    block = F.col("_block") * copies_per_task
    many = _numbered(
        counted.filter(F.col("_copies") > copies_per_task)
        .withColumn("_block", F.explode(
            F.sequence(F.lit(0).cast("bigint"),
                       F.floor((F.col("_copies") - 1) / copies_per_task))))
        .repartition("_digest", "_block"),
        block, F.least(top, block + (copies_per_task - 1)), columns,
    )
    return few.unionByName(many).select(
        *columns, F.concat_ws("-", "_digest", "_ordinal").alias(name)
    )
