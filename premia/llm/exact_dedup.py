"""Exact duplicates: frequent digests are settled map-side, all others by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from premia.llm.common import BLANK, beside, fresh, numbered, stored, text_of

FREQUENT = 1000
TRACKED = 8192
MERGERS = 64


def digest(text: str):
    """SHA-256 of the text with every run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_of(text), BLANK + "+", " "), 256)


def frequent_digests(rows: DataFrame, frequent: int, tracked: int) -> DataFrame:
    """At most ``frequent`` digests that hold, with their exact sizes and winners.

    Misra-Gries counters (Spark's frequent-items sketch, ``tracked`` counters at most) run in each task, are
    merged in groups of tasks and then once more; every digest above rows / frequent is among the
    candidates. A second pass counts the candidates exactly; those with copies stay.
    """
    sketches = (rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger"))
                .agg(F.expr(f"approx_top_k_accumulate(short, {tracked})").alias("sketch")))
    candidates = (sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch), {frequent})").alias("top"))
                  .select(F.explode("top").alias("t")).select(F.col("t.item").alias("short")))
    return (rows.join(F.broadcast(candidates), "short", "left_semi")
            .groupBy("digest")
            .agg(F.min(F.struct("no_id", "id", "rid")).alias("first"), F.count(F.lit(1)).alias("size"))
            .filter("size > 1")
            .orderBy(F.desc("size"), "digest").limit(frequent))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None,
                frequent: int = FREQUENT, tracked: int = TRACKED) -> DataFrame:
    """One row per document: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``row_id``.

    Of equal texts the row with the smallest id stays; a null id comes last, and of rows that repeat
    the id too, exactly one stays. Null and empty texts are one group. Extra columns are ignored.
    An empty table gives an empty result. A digest that a third of all rows share never
    meets in one task: the broadcast side has ``frequent`` rows at most, and every other group is
    smaller than about rows / ``frequent``.
    """
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).alias("id"), rid.alias("rid"), F.unhex(digest(text_col)).alias("digest"))
    rows = stored(base, "exact-dedup").withColumn("short", F.xxhash64("digest")).withColumn("no_id", F.col("id").isNull())
    winners = frequent_digests(rows, frequent, tracked)
    marked = rows.drop("short").join(F.broadcast(winners), "digest", "left")
    settled = marked.filter("size IS NOT NULL")
    same = Window.partitionBy("digest")
    rest = (marked.filter("size IS NULL")
            .withColumn("first", F.min(F.struct("no_id", "id", "rid")).over(same))
            .withColumn("size", F.count(F.lit(1)).over(same)))
    return settled.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("rid") == F.col("first.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("rid").alias(fresh(docs.select(id_col), "row_id")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text an earlier row has; columns as they were."""
    rows, rid = numbered(docs, "exact-dedup-rows")
    found, fact = exact_dedup(rows, row_id=rid).select(F.col("row_id").alias(rid), "kept"), fresh(rows, "fact")
    return beside(rows, rid, found, fact).filter(F.col(f"{fact}.kept")).select(docs.columns)
