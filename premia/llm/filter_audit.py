"""How text filters interact: what each removes, repeats and alone catches, in every order of the filters."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from premia.llm.common import small_batches, text_of
from premia.llm.text_tries import CELL_BYTES, LOCAL_BYTES, RANGE_BYTES, collapse, smallest_ids

FILTERS = "ABCDE"
#: Fixed values of the five filters.
FEWEST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITAL_PERCENT = 3
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))
REPEATED = 1 << FILTERS.index("E")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a whole text fails. Words end at ASCII white space."""
    words = text.split()
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < FEWEST_WORDS)
            + 2 * (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words))
            + 4 * (100 * capitals > MOST_CAPITAL_PERCENT * points)
            + 8 * (len(text.translate(None, SIGNS)) < len(text)))


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                  cell_bytes: int = CELL_BYTES, range_bytes: int = RANGE_BYTES, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One row per document: ``id``, ``part``, ``mask`` (bit 0 for A up to bit 4 for E).

    A null text is empty, a null part is the empty string. E is failed by a text that also a smaller id has,
    anywhere in the table; a null id is neither smaller nor larger than another, and rows that repeat the smallest id
    all pass. A text that a third of all rows share goes to the shuffle once per task; documents meet their text's
    smallest id by the task's own entry, so no group is larger than one task's rows.
    """
    small_batches(docs.sparkSession)
    entries = collapse(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                                   text_of(text_col).cast("binary").alias("text")), failures, local_bytes)
    first = smallest_ids(entries, cell_bytes, range_bytes)
    rows = entries.filter("text IS NULL").select("entry", "id", "part", "mask").join(first, "entry")
    copy = F.coalesce(F.col("id") > F.col("smallest"), F.lit(False))
    return rows.select("id", "part", F.when(copy, F.col("mask") + REPEATED).otherwise(F.col("mask")).alias("mask"))


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, filter, its ``bit``, and ``before``, the bits of the filters applied earlier."""
    bits = {f: 1 << i for i, f in enumerate(filters)}
    return spark.createDataFrame(
        [("".join(order), at + 1, f, bits[f], sum(bits[g] for g in order[:at]))
         for order in permutations(filters) for at, f in enumerate(order)],
        "filter_order string, step int, filter string, bit int, before int")


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic) of each document.

    ``kept`` pass every filter up to the step, ``removed`` fail it as their first, ``redundant`` fail it
    after an earlier one, ``unique_fails`` fail no other filter at all; ``good_lost`` and ``toxic_lost`` are the removed ones
    with the flag; ``shapley`` adds up what the step's filter removes over all orders. The documents are first
    reduced to a count per part, mask and flags; only those few counts meet the orders.
    """
    counts = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(F.col("toxic")).alias("toxic"))
    plan = steps(masks.sparkSession, filters).withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(what: Column, when: Column) -> Column:
        return F.sum(F.when(when, what).otherwise(0)).cast("long")

    by_step = (counts.join(F.broadcast(plan), "mask").groupBy("part", "filter_order", "step", "filter").agg(
        total(F.col("n"), ~fails & ~gone).alias("kept"),
        total(F.col("n"), fails & ~gone).alias("removed"),
        total(F.col("n"), fails & gone).alias("redundant"),
        total(F.col("n"), F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(F.col("good"), fails & ~gone).alias("good_lost"),
        total(F.col("toxic"), fails & ~gone).alias("toxic_lost")))
    # Every order of a part's few hundred rows; no row of a document is left here.
    shares = by_step.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return by_step.join(shares, ["part", "filter"]).drop("filter")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                  good_col: str = "quality", toxic_col: str = "toxic", **sizes: int) -> DataFrame:
    """``interactions`` of the five filters over whole ``docs``.

    A document counts as good or toxic if any label row of its id says 1; ids that are null or have no label
    count as neither. Rows that repeat an id are documents each. Extra columns are ignored. An empty table gives no rows.
    """
    said = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
            .agg(F.max(F.coalesce(F.col(good_col) == 1, F.lit(False))).alias("good"),
                 F.max(F.coalesce(F.col(toxic_col) == 1, F.lit(False))).alias("toxic")))
    masks = failure_masks(docs, id_col, text_col, part_col, **sizes)
    flagged = masks.join(said, "id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return interactions(flagged)
