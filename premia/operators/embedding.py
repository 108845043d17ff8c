"""Embedding a chunk table: hashed TF-IDF built in, any other model as a column function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS = 256


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def _hex_digits(dimensions: int) -> int:
    """k where ``dimensions`` is 16 to the k, else 0."""
    return next((k for k in range(1, 8) if 16**k == dimensions), 0)


def _slot_names(dimensions: int) -> list[str]:
    digits = _hex_digits(dimensions)
    return [f"{i:0{digits}x}" if digits else str(i) for i in range(dimensions)]


def _slots(text: Column, dimensions: int) -> Column:
    """Each term's slot name: the first eight hex digits of its MD5, modulo the dimensions.

    With a power of 16 that is just the last of these digits, without arithmetic.
    """
    digits = _hex_digits(dimensions)

    def slot(term: Column) -> Column:
        digest = F.md5(term.cast("binary"))
        if digits:
            return F.substring(digest, 9 - digits, digits)
        number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        return (number % dimensions).cast("string")

    return F.transform(terms(text), slot)


def count_terms(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Add slot_counts: how often each slot occurs in the text.

    Finding the terms is most of the work of an embedding. Stored with the chunks, the counts take the text's place
    in ``fit_tfidf`` and ``embed``.
    """
    counter = CountVectorizerModel.from_vocabulary(
        _slot_names(dimensions), inputCol="_slots", outputCol="slot_counts")
    return counter.transform(df.withColumn("_slots", _slots(F.col(text), dimensions))).drop("_slots")


@dataclass
class TfidfEmbedder:
    """Fitted inverse document frequencies; everything it does to a row is narrow."""

    stages: PipelineModel
    dimensions: int
    name: str

    def embed(self, df: DataFrame, text: str = "text") -> DataFrame:
        counted = df if "slot_counts" in df.columns else count_terms(df, text, self.dimensions)
        return self.stages.transform(counted).withColumn(
            "embedding", vector_to_array("_unit", "float32")).drop("slot_counts", "_weighted", "_unit")


def fit_tfidf(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> TfidfEmbedder:
    """Document frequencies over the whole table, in one tree aggregation of one vector."""
    counted = df if "slot_counts" in df.columns else count_terms(df.select(text), text, dimensions)
    idf = IDF(inputCol="slot_counts", outputCol="_weighted").fit(counted.select("slot_counts"))
    unit = Normalizer(inputCol="_weighted", outputCol="_unit", p=2.0)
    return TfidfEmbedder(PipelineModel([idf, unit]), dimensions, f"hashed-tfidf-{dimensions}")


def embed_chunks(chunks: DataFrame, embedder: TfidfEmbedder | Callable[[Column], Column],
                 model_name: str | None = None, text: str = "text") -> DataFrame:
    """Add embedding and embedding_model; ``embedder`` is a fitted one or a column function."""
    if isinstance(embedder, TfidfEmbedder):
        made, name = embedder.embed(chunks, text), model_name or embedder.name
    else:
        if not model_name:
            raise ValueError("name the model, so that stale vectors can be found later")
        made, name = chunks.withColumn("embedding", embedder(F.col(text))), model_name
    return made.withColumn("embedding_model", F.lit(name))
