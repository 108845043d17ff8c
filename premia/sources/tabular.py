"""Files coming in: reading CSV, fingerprints, upload screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from premia.settings import (
    ALLOWED_EXTENSIONS, FINGERPRINT_BLOCK_BYTES, MAX_UPLOAD_BYTES, MISSING_TOKENS,
)
from premia.sources.digests import escape_glob, readable_in_blocks, sha256_in_blocks

_WHOLE = r"^\s*[+-]?\d+\s*$"
_DECIMAL = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_TRUTH = r"^(?i:true|false)$"


def _typed(text: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return text
    return text.try_cast(data_type)


def infer_types(df: DataFrame) -> list[T.DataType]:
    """The narrowest of long, double, boolean, string for each all-text column, in one pass."""
    tests = []
    for name in df.columns:
        text = F.col(f"`{name}`")
        tests += [
            F.count(text),
            F.count_if(text.rlike(_WHOLE) & text.try_cast("bigint").isNotNull()),
            F.count_if(text.rlike(_DECIMAL)),
            F.count_if(text.rlike(_TRUTH)),
        ]
    row = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first()
    types: list[T.DataType] = []
    for i in range(len(df.columns)):
        filled, whole, decimal, truth = row[4 * i:4 * i + 4]
        if filled and whole == filled:
            types.append(T.LongType())
        elif decimal == filled:  # also a column without any value
            types.append(T.DoubleType())
        elif truth == filled:
            types.append(T.BooleanType())
        else:
            types.append(T.StringType())
    return types


def _refuse_surplus(spark: SparkSession, path: str, names: list[str], options: dict) -> DataFrame:
    """The rows of a CSV file as text; one with more cells than ``names`` raises an error when it is read."""
    broken = "_broken"
    while broken.lower() in {n.lower() for n in names}:
        broken += "_"
    cells = T.StructType([T.StructField(n, T.StringType()) for n in [*names, broken]])
    rows = spark.read.option("columnPruning", False).csv(
        path, schema=cells, mode="PERMISSIVE", columnNameOfCorruptRecord=broken, **options)
    # Spark marks rows with too few cells too; quoted cells count as one, whatever is in them.
    plain = F.regexp_replace(F.col(broken), r'(^|,)\s*"(?:[^"]|"")*"', "$1")
    surplus = F.regexp_count(plain, F.lit(",")) >= len(names)
    # Names a cell as well, since Spark refuses to read the record column alone.
    said = F.concat(F.lit(f"row with more than {len(names)} cells: "), F.col(broken),
                    F.coalesce(F.substring(F.col(f"`{names[0]}`"), 1, 0), F.lit("")))
    return rows.filter(F.when(surplus, F.raise_error(said).cast("boolean")).otherwise(True)).drop(broken)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 multi_line: bool = False) -> DataFrame:
    """A CSV file or folder with a header row, missing-value tokens read as null.

    Without a schema the types are inferred after the tokens are removed, so a column of numbers
    with ``N/A`` in it stays numeric. ``multi_line`` allows line breaks inside quotes, at the price
    of files that cannot be split. A row with more cells than the header is refused: reading it
    fails and names it. Missing cells at the end of a row are null.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    raw = spark.read.csv(path, inferSchema=False, **options)
    if raw.columns:
        raw = _refuse_surplus(spark, path, raw.columns, options)
    cleaned = raw.select(*[
        F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")).alias(c)
        for c in raw.columns
    ])
    types = [f.dataType for f in schema.fields] if schema else infer_types(cleaned)
    names = schema.names if schema else raw.columns
    return cleaned.select(*[
        _typed(F.col(f"`{c}`"), t).alias(n) for c, t, n in zip(raw.columns, types, names)
    ])


def fingerprint_files(spark: SparkSession, path: str, block_bytes: int = FINGERPRINT_BLOCK_BYTES,
                      parallel: int = 4) -> DataFrame:
    """path, file_size_bytes and the SHA-256 of each file under ``path``, whatever its size.

    A file above ``block_bytes`` (a power of two, 1 MB at least) is digested when this is called, block
    by block: each task reads one block and hands the state of the digest to the next, ``parallel``
    files at a time; the driver sees paths, lengths and states. Other files are one binary value each.
    So are large ones that Hadoop takes for compressed by their names (``.gz``), and all of them if
    Python has no OpenSSL to hand on a state; Spark limits such a value to 2 GB. The size limit of
    uploads is ``screen_uploads``'s.
    """
    if block_bytes < 1 << 20 or block_bytes & (block_bytes - 1):
        raise ValueError("block_bytes must be a power of two, 1 MB at least")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = files.filter(F.col("length") > block_bytes).select("path", "length").collect()
    in_blocks = readable_in_blocks(spark, [f.path for f in listed])
    large = [(f.path, f.length) for f in listed if f.path in in_blocks]
    whole = [escape_glob(f.path) for f in listed if f.path not in in_blocks]
    files = files.filter(F.col("length") <= block_bytes)
    if whole:
        files = files.unionByName(spark.read.format("binaryFile").load(whole))
    hashed = files.select("path", F.col("length").alias("file_size_bytes"),
                          F.sha2("content", 256).alias("file_hash"))
    if not large:
        return hashed
    return hashed.unionByName(spark.createDataFrame(
        sha256_in_blocks(spark, large, block_bytes, parallel), hashed.schema))


def file_extension(filename: Column) -> Column:
    """Lower-case extension; empty for names without one and for dot files."""
    return F.lower(F.regexp_extract(filename, r"[^/]\.([^./]+)$", 1))


def screen_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add accepted and reason; ``files`` has original_filename and file_size_bytes."""
    reason = (
        F.when(~file_extension(F.col("original_filename")).isin(*ALLOWED_EXTENSIONS),
               "file_type_not_allowed")
        .when(F.col("file_size_bytes") > max_bytes, "file_too_large")
    )
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
