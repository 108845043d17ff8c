"""What the corpus operators share: row ids, text keys, gapless ranks and connected components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from premia.session import shared_folder

# Fixed value: the white space of the corpus contracts, as a Java regular expression.
BLANK = r"[\x20\x09-\x0D]"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Rows of a block of numbered rows, as a power of two; ``beside`` holds the facts of so many rows at once.
_BLOCK_BITS = 12
# Blocks fall into buckets by a hash; with several buckets for each partition of a shuffle few of them meet in one.
_BUCKETS = 4


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(paths: list[str]) -> Iterator[None]:
    """Note the folders that ``stored`` writes meanwhile in ``paths``."""
    before = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(before)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``scratch`` noted; nothing may read them any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` (compressed) below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: what follows reads shared files, so a lost executor costs only its own tasks, and
    the shuffles behind the table go from the disks as soon as it is written.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    if _scratch.get() is not None:
        _scratch.get().append(path)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def _block_of(rid: str) -> str:
    return f"{rid}_block"


def _buckets(spark: SparkSession) -> int:
    return _BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, purpose: str, name: str = "row_id") -> tuple[DataFrame, str]:
    """``docs`` stored with a row id that is unique and stays the same, and that column's name.

    Rows that repeat an id, or even whole rows, stay apart by it. A task numbers its rows on end; each block of
    4,096 numbers lies in one bucket of the files, where ``beside`` finds it without a shuffle.
    """
    spark, taken = docs.sparkSession, {c.lower() for c in docs.columns}
    rid = fresh(docs, name)
    while _block_of(rid) in taken:
        rid += "_"
    rows = docs.withColumn(rid, F.monotonically_increasing_id()).withColumn(_block_of(rid), F.shiftright(rid, _BLOCK_BITS))
    path, table = shared_folder(spark, purpose), f"rows_{uuid.uuid4().hex}"
    if _scratch.get() is not None:
        _scratch.get().append(path)
    before = {key: spark.conf.get(key, value) for key, value in ((_CLEAN_UP, "false"), (_WRITERS, "0"))}
    spark.conf.set(_CLEAN_UP, "true")
    # rows come block by block; without writers of their own, Spark would sort all texts by bucket
    spark.conf.set(_WRITERS, "8")
    try:
        (rows.write.option("compression", "zstd").option("path", path)
         .bucketBy(_buckets(spark), _block_of(rid)).saveAsTable(table))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    kept = spark.table(table)
    # only the name goes; the files are in the shared folder
    spark.sql(f"DROP TABLE {table}")
    return kept, rid


def beside(rows: DataFrame, rid: str, facts: DataFrame, name: str) -> DataFrame:
    """``rows`` of ``numbered`` with the struct ``name`` of the columns that ``facts`` has for their row id.

    ``facts`` has each row id exactly once; anything else is an error. Only facts are shuffled, never the rows: the facts of
    a block come together in the order of its row ids, in the bucket that holds the block, and a row finds its own by place.
    """
    place = F.col(rid).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int")
    block, others = _block_of(rid), F.struct(*[F.col(c) for c in facts.columns if c != rid])
    gathered = (facts.select(F.shiftright(rid, _BLOCK_BITS).alias(block), F.struct(F.col(rid).alias("rid"), others.alias("fact")).alias("_one"))
                .repartition(_buckets(rows.sparkSession), block).groupBy(block).agg(F.sort_array(F.collect_list("_one")).alias("_facts")))
    own = F.get("_facts", place)
    wrong = F.raise_error(F.concat(F.lit("not one fact for row "), F.col(rid).cast("string")))
    return rows.join(gathered.hint("shuffle_hash"), block, "left").withColumn(
        name, F.when(own["rid"] == F.col(rid), own["fact"]).otherwise(wrong)).drop(block, "_facts")


def among(rows: DataFrame, rid: str, wanted: DataFrame) -> DataFrame:
    """``rows`` of ``numbered`` whose row id the only column of ``wanted`` has; ids are shuffled, never the rows."""
    place = F.col(rid).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).cast("int")
    block = _block_of(rid)
    places = fresh(rows, "places")
    gathered = (wanted.select(F.shiftright(rid, _BLOCK_BITS).alias(block), place.alias(places))
                .repartition(_buckets(rows.sparkSession), block).groupBy(block).agg(F.collect_set(places).alias(places)))
    return rows.join(gathered.hint("shuffle_hash"), block).filter(F.array_contains(places, place)).drop(block, places)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, as one text may have hundreds of kilobytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, math.ceil(rows / per_bucket))


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str, per_bucket: int = 512) -> DataFrame:
    """Add ``rank``: 0, 1, 2 … without gaps inside each of a few ``groups``, in a seeded order.

    A group may hold any share of the rows. It gets a bucket for every ``per_bucket`` rows; rows are
    dealt to them by a hash of ``order`` (which must tell rows apart), ranked inside the bucket, and shifted by
    the rows of the group's earlier buckets, so no task sorts more than about a bucket.
    """
    bucket, shift, many, parts = (fresh(df, c) for c in ("bucket", "shift", "many", "parts"))
    counted = df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / per_bucket).alias(parts))
    dealt = df.join(F.broadcast(counted), groups).withColumn(bucket, F.pmod(F.xxhash64(*order), F.col(parts))).drop(parts)
    sizes = dealt.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias(many))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*groups, bucket, F.coalesce(F.sum(many).over(before), F.lit(0)).alias(shift))
    inside = Window.partitionBy(*groups, bucket).orderBy(F.xxhash64(*order), *order)
    placed = dealt.withColumn(rank, F.row_number().over(inside).cast("long") - 1)
    return (placed.join(shifts, [*groups, bucket])
            .withColumn(rank, F.col(rank) + F.col(shift)).drop(bucket, shift))


def components(links: DataFrame, purpose: str) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``links`` (a, b).

    Only nodes that have a link come back. Alternates two steps until nothing changes: every node
    hands its smallest neighbour to its larger neighbours, then to its smaller ones. Each round
    is written to the shared folder; the driver sees one count and one checksum a round.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"),
                                                 F.least("a", "b").alias("v")).distinct(), purpose)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that the join can split a node with very many neighbours.
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), purpose)
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        edges = stored(small, purpose)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.groupBy("v").agg(F.lit(1).alias("one")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
