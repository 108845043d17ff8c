"""Tables that a stream writes one micro-batch at a time.

Each micro-batch owns a folder named after its id and overwrites it, so a batch that is run
again after a failure leaves the same result as one that ran once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All batches written so far, with their ``batch_id``; no rows before the first one."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(full).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def read_batch(spark: SparkSession, folder: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """One batch; no rows before the first one. A batch that should be there and is not, is an error."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch_id={batch_id}")
