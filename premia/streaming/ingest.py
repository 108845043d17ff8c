"""Continuous ingest of a drop folder, and duplicate suppression on a stream of uploads."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from premia.operators.columns import safe_column_names
from premia.settings import MISSING_TOKENS
from premia.streaming.files import read_batches, write_batch

STATUS_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("failed_rows", T.LongType()),
    T.StructField("reason", T.StringType()),
])


def _clean_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField(n, f.dataType) for n, f in zip(safe_column_names(schema.names), schema)])


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The cells of each file's first line, by file; a file without a line is left out."""
    lines = spark.read.text(paths).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    # ids grow along a block, so the least one of a file's first block is its first line
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("line"))
    return {r["file_path"]: next(csv.reader([r["line"].removeprefix("\ufeff")]), []) for r in first.collect()}


def _typed_rows(spark: SparkSession, paths: list[str], header: list[str], schema: T.StructType) -> DataFrame:
    """(file_path, _misfit, columns of the clean schema) of files that share a header."""
    cells = [f"c{i}" for i in range(len(header))]
    raw = (
        spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in [*cells, "_corrupt"]]))
        .option("header", "true").option("escape", '"').option("columnPruning", "false")
        .option("columnNameOfCorruptRecord", "_corrupt").csv(paths)
    )
    place = {name: cell for name, cell in zip(safe_column_names(header), cells)}
    misfit, typed = F.col("_corrupt").isNotNull(), []
    for field in _clean_schema(schema):
        text = F.when(~F.col(place[field.name]).isin(*MISSING_TOKENS), F.col(place[field.name]))
        value = text.try_cast(field.dataType)
        misfit = misfit | (text.isNotNull() & value.isNull())
        typed.append(value.alias(field.name))
    return raw.select(F.col("_metadata.file_path").alias("file_path"), misfit.alias("_misfit"), *typed)


def stream_ingest(spark: SparkSession, folder: str, schema: T.StructType, out: str,
                  max_files_per_batch: int = 1000) -> StreamingQuery:
    """Read the CSV files that arrive in ``folder`` and stop when all of them are read.

    The stream is the listing of the folder; a micro-batch reads its files' headers, then the files of each
    header together. Columns are found by their name (see ``safe_column_names``), in any order; columns
    beyond ``schema`` are left out. Rows of clean files go to ``out/rows`` under safe column names.
    ``out/status`` gets one row per file: ready (with no rows if there is only a header), or failed with a reason:
    no header, missing columns, or rows in which a value does not fit its column or cells are too many or too few.
    A failed file contributes no rows. Spark lists no file of zero bytes, so it has no status. Run it again, or on a schedule, to pick up new files.
    The driver sees the names and headers of at most ``max_files_per_batch`` files.
    """
    listing = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", max_files_per_batch).load(folder)
        .select("path", F.col("_metadata.file_path").alias("file_path"))
    )
    clean = _clean_schema(schema)

    def publish(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        files = {r["file_path"]: r["path"] for r in batch.collect()}
        headers = _headers(session, list(files.values())) if files else {}
        reasons: list[tuple[str, str | None]] = []
        alike: dict[tuple[str, ...], list[str]] = {}
        for file in sorted(files):
            header = headers.get(file, [])
            missing = [n for n in clean.names if n not in safe_column_names(header)]
            reason = None if header and not missing else "missing columns: " + ", ".join(missing) if header else "no header"
            reasons.append((file, reason))
            if reason is None:
                alike.setdefault(tuple(header), []).append(files[file])
        rows = session.createDataFrame([], T.StructType([
            T.StructField("file_path", T.StringType()), T.StructField("_misfit", T.BooleanType()), *clean]))
        for header, paths in alike.items():
            rows = rows.unionByName(_typed_rows(session, paths, list(header), schema))
        rows = rows.persist()
        try:
            counted = rows.groupBy("file_path").agg(
                F.count(F.lit(1)).alias("row_count"), F.count_if("_misfit").alias("failed_rows"))
            listed = F.broadcast(session.createDataFrame(reasons, "file_path string, refused string"))
            failed_rows = F.coalesce("failed_rows", F.lit(0))
            reason = F.coalesce("refused", F.when(failed_rows > 0, "rows that do not fit"))
            status = listed.join(counted, "file_path", "left").select(
                "file_path", F.when(reason.isNull(), "ready").otherwise("failed").alias("status"),
                F.coalesce("row_count", F.lit(0)).alias("row_count"), failed_rows.alias("failed_rows"),
                reason.alias("reason"))
            failed = counted.filter("failed_rows > 0").select("file_path")
            write_batch(rows.join(failed, "file_path", "left_anti").select(*clean.names),
                        f"{out}/rows", batch_id)
            write_batch(status, f"{out}/status", batch_id)
        finally:
            rows.unpersist()

    return (
        listing.writeStream.foreachBatch(publish)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )


def ingested_rows(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return read_batches(spark, f"{out}/rows", _clean_schema(schema)).drop("batch_id")


def ingest_status(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/status", STATUS_SCHEMA)


def stream_dedupe(uploads: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """Drop uploads whose key was seen up to ``within`` before; state older than that is freed."""
    return uploads.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
