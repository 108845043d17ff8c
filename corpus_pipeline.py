"""Training corpus pipeline: language, exact copies, near copies, source mix, packed sequences.

Each stage takes the documents its predecessor kept. ``run`` writes each stage's rows below
``spark.checkpoint.dir`` and reads them again, so an executor that is lost costs no earlier stage. A stage's result
may read the tables the stage has stored on its way; they are deleted when the next stage begins, which reads the
written rows of its predecessor and nothing else.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from premia.llm import exact_dedup, jaccard_join, language, mixing, packing
from premia.llm.common import discard, scratch, stored
from premia.llm.queries import word_tokenizer
from premia.session import tune


_inner: dict[str, list[str]] = {}


def staged(stage):
    """A stage of (spark, docs, sf_dir) that first deletes what the stage before it has stored on its way."""

    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark)
        paths = _inner.setdefault(spark.sparkContext.applicationId, [])
        discard(spark, paths)
        with scratch(paths):
            return stage(spark, docs, sf_dir)

    return begin


@staged
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go; so does everything if no row has a language."""
    return language.drop_unknown(docs)


@staged
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays (null last, then any one row)."""
    return exact_dedup.drop_copies(docs)


@staged
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays; texts without words are linked with nothing."""
    return jaccard_join.drop_near_copies(docs)


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one it takes no word of goes."""
    return mixing.mixed(docs)


@staged
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids; an empty text is one piece of its end id. An empty table gives no rows in any stage."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express the trained stages; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces of packed sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
