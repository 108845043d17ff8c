"""Vector top-k for many questions, and re-scoring of the candidates.

Both vector searches use the same block join: the vectors of a scope are cut into blocks of
bounded size, each block meets blocks of the scope's questions, and a block hands on only its
best k per question. A tenant that owns a third of all vectors becomes many blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from premia.operators.embedding import terms
from premia.session import materialize
from premia.settings import TOP_K_RERANK, TOP_K_RETRIEVE

VECTORS_PER_BLOCK = 32_768
QUESTIONS_PER_BLOCK = 4_096
# Questions scored at once inside a block; bounds the score matrix to 32 MB.
_SLICE = 128
_NO_MATCH = -2.0
# Scores rank on this many digits, so that equal vectors tie whatever block they are in, ...
_RANK_DIGITS = 12
# ... and are shown with this many.
_SHOWN_DIGITS = 4


def _unit_rows(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype("float64")
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores; equal scores keep their order."""
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _block_scorer(k: int, filtered: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def score(vectors: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"question_id": [], "chunk_id": [], "similarity_score": []}
        if len(vectors) and len(questions):
            vectors = vectors.sort_values("chunk_id", kind="stable")
            ids = vectors["chunk_id"].to_numpy()
            matrix = _unit_rows(vectors["embedding"]).T
            asked = _unit_rows(questions["embedding"])
            names = questions["question_id"].to_numpy()
            documents = vectors["document_id"].to_numpy() if filtered else None
            allowed = questions["document_ids"].to_numpy() if filtered else None
            for start in range(0, len(asked), _SLICE):
                scores = np.round(asked[start:start + _SLICE] @ matrix, _RANK_DIGITS) + 0.0
                for row, name in zip(range(len(scores)), names[start:start + _SLICE]):
                    mine = scores[row]
                    if filtered and allowed[start + row] is not None and len(allowed[start + row]):
                        mine = np.where(np.isin(documents, allowed[start + row]), mine, _NO_MATCH)
                    places = _best(mine, k)
                    places = places[mine[places] > _NO_MATCH]
                    found["question_id"].extend([name] * len(places))
                    found["chunk_id"].extend(ids[places])
                    found["similarity_score"].extend(mine[places])
        return pd.DataFrame(found)

    return score


def _scored_in_blocks(questions: DataFrame, vectors: DataFrame, scope: list[str], k: int,
                      vectors_per_block: int, questions_per_block: int) -> DataFrame:
    """Best k per question and block; several blocks of a scope may answer one question."""
    filtered = "document_ids" in questions.columns
    # a chunk that waits for its vector is normal and matches nothing
    vectors = vectors.filter(F.col("embedding").isNotNull()).withColumn("_width", F.size("embedding"))
    questions = questions.filter(F.col("embedding").isNotNull()).withColumn("_width", F.size("embedding"))
    # vectors of another width or another model have no angle to the question's
    scope = [*scope, "_width"]
    if "embedding_model" in vectors.columns and "embedding_model" in questions.columns:
        scope.append("embedding_model")

    # a null tenant or model is nobody's; widths and cells of a vector are never null, and testing them makes it twice
    owned = [c for c in scope if c in ("tenant_id", "embedding_model")]
    vectors, questions = vectors.dropna(subset=owned), questions.dropna(subset=owned)

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))

    counts = ["_vector_blocks", "_question_blocks"]
    # Only scopes of several blocks, of which there are at most as many as blocks, so the table is small enough to
    # send everywhere. A join by scope would put all vectors of a tenant into one task.
    grid = F.broadcast(
        blocks(vectors, vectors_per_block, "_vector_blocks")
        .join(blocks(questions, questions_per_block, "_question_blocks"), scope, "full")
        .na.fill(0, counts).filter(F.greatest(*counts) > 1))

    def in_grid(df: DataFrame) -> DataFrame:
        # other scopes are one block of vectors and one of questions; a scope without either has no answers
        return df.join(grid, scope, "left").na.fill(1, counts).filter(F.least(*counts) > 0)

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))

    cell = [*scope, "_vb", "_qb"]
    left = (
        in_grid(vectors.select(*scope, "chunk_id", "embedding", *(["document_id"] if filtered else [])))
        .withColumn("_vb", F.pmod(F.xxhash64("chunk_id"), F.col("_vector_blocks")))
        .withColumn("_qb", every("_question_blocks"))
        .drop(*counts)
    )
    right = (
        in_grid(questions.select(*scope, "question_id", "embedding",
                                 *(["document_ids"] if filtered else [])))
        .withColumn("_qb", F.pmod(F.xxhash64("question_id"), F.col("_question_blocks")))
        .withColumn("_vb", every("_vector_blocks"))
        .drop(*counts)
    )
    schema = T.StructType([
        T.StructField("question_id", questions.schema["question_id"].dataType),
        T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
        T.StructField("similarity_score", T.DoubleType()),
    ])
    # fresh column identities, since questions and vectors may come from the same table
    right = right.toDF(*right.columns)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        _block_scorer(k, filtered), schema)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """Best k per question; the rank limit prunes in every task before the shuffle."""
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity_score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .withColumn("similarity_score", F.round("similarity_score", _SHOWN_DIGITS))


def vector_top_k(questions: DataFrame, vectors: DataFrame, k: int = TOP_K_RETRIEVE,
                 vectors_per_block: int = VECTORS_PER_BLOCK,
                 questions_per_block: int = QUESTIONS_PER_BLOCK) -> DataFrame:
    """Exact cosine top-k of each question inside its tenant.

    ``questions``: question_id, tenant_id, embedding and optionally document_ids (null or empty
    means no document filter). ``vectors``: chunk_id, tenant_id, embedding, and document_id if
    questions filter on it. Scores are shown with 4 digits but rank in full; equal ones rank by
    chunk_id.
    """
    return _ranked(_scored_in_blocks(questions, vectors, ["tenant_id"], k, vectors_per_block,
                                     questions_per_block), k)


@dataclass
class CellIndex:
    """Centres of the cells a vector table is divided into."""

    centres: np.ndarray

    def _nearest(self, n: int, returns: str):
        centres = self.centres

        @F.pandas_udf(returns)
        def nearest(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            order = np.argsort(-(_unit_rows(vectors) @ centres.T), axis=1, kind="stable")[:, :n]
            return pd.Series(list(order.astype("int32")))

        return nearest

    def assign(self, vectors: DataFrame) -> DataFrame:
        return vectors.withColumn(
            "cell", F.get(self._nearest(1, "array<int>")(F.col("embedding")), F.lit(0)))

    def probe(self, questions: DataFrame, probes: int) -> DataFrame:
        return questions.withColumn(
            "cell", F.explode(self._nearest(probes, "array<int>")(F.col("embedding"))))


def build_cells(vectors: DataFrame, cells: int, seed: int = 7) -> CellIndex:
    """Learn cell centres from all vectors. What reaches the driver is ``cells`` vectors."""
    # a vector of zeros has no direction to learn from
    pointed = vectors.filter(F.exists("embedding", lambda x: x != 0))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(
        pointed.select(array_to_vector(F.col("embedding")).alias("features")))
    return CellIndex(_unit_rows(pd.Series(list(model.clusterCenters()))))


def vector_top_k_approx(questions: DataFrame, vectors: DataFrame, index: CellIndex,
                        probes: int, k: int = TOP_K_RETRIEVE,
                        vectors_per_block: int = VECTORS_PER_BLOCK,
                        questions_per_block: int = QUESTIONS_PER_BLOCK) -> DataFrame:
    """Top-k among the vectors of the ``probes`` cells nearest to each question, scored exactly.

    With as many probes as cells the result is exact. A crowded cell is split like a tenant. A
    question whose cells hold fewer than k vectors is searched again exactly, so that no question
    gets fewer answers than there are.
    """
    vectors = vectors.filter(F.col("embedding").isNotNull())
    questions = questions.filter(F.col("embedding").isNotNull())
    near = materialize(_ranked(
        _scored_in_blocks(index.probe(questions, probes), index.assign(vectors),
                          ["tenant_id", "cell"], k, vectors_per_block, questions_per_block), k),
        "near")
    enough = near.filter(F.col("rank") == k).select("question_id")
    short = questions.join(enough, "question_id", "left_anti")
    return near.join(enough, "question_id", "left_semi").unionByName(
        vector_top_k(short, vectors, k, vectors_per_block, questions_per_block))


def lexical_overlap(question: Column, text: Column) -> Column:
    """Number of distinct terms of the question that the text contains."""
    return F.size(F.array_intersect(terms(question), terms(text))).cast("double")


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_overlap,
           k: int = TOP_K_RERANK) -> DataFrame:
    """The best k candidates per question by a pair score; a lone candidate gets no score.

    ``candidates``: question_id, question, chunk_id, text, similarity_score; the first search
    bounds the candidates of a question. Equal scores keep the order of the first search.
    """
    mine = Window.partitionBy("question_id")
    scored = candidates.withColumn("_n", F.count(F.lit(1)).over(mine)).withColumn(
        "rerank_score",
        F.when(F.col("_n") > 1, scorer(F.col("question"), F.col("text"))))
    order = mine.orderBy(F.desc("rerank_score"), F.desc("similarity_score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)) \
        .filter(F.col("rank") <= k).drop("_n")


def attach_texts(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Join chunk columns to hits; only hits travel through the search, never the texts."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")
