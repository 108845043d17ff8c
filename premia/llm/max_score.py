"""Exact top-k inner products with MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from premia.llm.common import buckets_for, stored

SHARD_ROWS = 4096
QUERY_ROWS = 2048
SCHEMA = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): floor(scale * component) as longs; vectors that are null or hold null or non-finite parts go."""
    usable = (F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
              & ~F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x"))


class Postings:
    """One shard: a list per term, where a term is a component and a sign.

    A list holds the rows whose component has that sign, so a query meets a gain only on the
    lists of its own signs; the largest component of a list bounds what the term can add.
    """

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(matrix[order].T)
        top = self.columns.max(axis=1, initial=0)
        low = self.columns.min(axis=1, initial=0)
        self.bounds = np.stack([np.maximum(top, 0), np.maximum(-low, 0)])

    def members(self, term: int, positive: bool) -> np.ndarray:
        return self.columns[term] > 0 if positive else self.columns[term] < 0

    def search(self, query_id: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, then smaller id) that reach ``floor``, the k-th best score so far."""
        gain = np.abs(q) * self.bounds[(q < 0).astype(int), np.arange(len(q))]
        order = np.argsort(-gain, kind="stable")
        left = np.append(np.cumsum(gain[order][::-1])[::-1], 0)
        essential = len(q) if floor is None else int(np.searchsorted(-left, -floor, side="right"))
        essential = min(essential, len(q))
        if floor is None or floor <= 0:
            rows = np.arange(len(self.ids))
        else:
            met = np.zeros(len(self.ids), bool)
            for t in order[:essential]:
                met |= self.members(t, q[t] > 0)
                if met.all():
                    break
            rows = np.flatnonzero(met)
        rows = rows[self.ids[rows] != query_id]
        score = np.zeros(len(rows), q.dtype)
        done = 0
        while done < len(q) and len(rows):
            step = order[done:done + 16]
            score = score + q[step] @ self.columns[np.ix_(step, rows)]
            done += len(step)
            least = floor
            if done < len(q) and least is not None:
                alive = score + left[done] >= least
                rows, score = rows[alive], score[alive]
        if floor is not None:
            good = score >= floor
            rows, score = rows[good], score[good]
        if len(rows) > k:
            cut = np.partition(score, len(rows) - k)[len(rows) - k]
            good = score >= cut
            rows, score = rows[good], score[good]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def search_shard(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one shard for each query of one block; vectors of other widths never meet."""
    out = []
    for width in sorted(set(queries["x"].map(len)) & set(rows["x"].map(len))):
        asked, held = (f[f["x"].map(len) == width] for f in (queries, rows))
        q, m = (np.array(f["x"].tolist(), dtype=np.int64).reshape(len(f), width) for f in (asked, held))
        largest = max(width, 1) * _size(q) * _size(m)
        # Doubles hold whole numbers up to 2**53 and multiply faster; beyond 64 bits Python's integers count.
        kind = np.float64 if largest < 2**53 else np.int64 if largest < 2**62 else object
        shard = Postings(held["id"].to_numpy(), m.astype(kind))
        seed = Postings(shard.ids[:: max(1, len(shard.ids) // 512)], shard.columns.T[:: max(1, len(shard.ids) // 512)])
        for query_id, vector in zip(asked["id"], q.astype(kind)):
            _, first = seed.search(query_id, vector, k, None)
            ids, score = shard.search(query_id, vector, k, first[-1] if len(first) == k else None)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids,
                                     "score": [int(np.clip(int(s), -(2**63), 2**63 - 1)) for s in score]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def _size(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` highest integer inner products of each query over all rows but its own id.

    ``queries`` and ``vectors`` have (id, x). Returns query_id, rank from 1, vec_id, score; ties go to the
    smaller vec_id. Every block of queries meets every shard of vectors; a shard hands on its k best.
    Per query, terms are ordered by what they can add. Terms that together cannot reach the k-th
    best score of a first sweep are non-essential: rows on none of the essential lists are skipped, the others are
    followed only while their score plus what is left can still reach it. Scores beyond 64 bits
    stop at the largest long. Rows that repeat an id are candidates each. Empty tables give no rows.
    """
    rows, asked = stored(vectors, "max-score"), stored(queries, "max-score-queries")
    shards = buckets_for(rows.count(), shard_rows)
    blocks = buckets_for(asked.count(), query_rows)

    def spread(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("id", "x"), F.lit(parts)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    left = spread(asked, "block", blocks, "shard", shards).groupBy("block", "shard")
    right = spread(rows, "shard", shards, "block", blocks).groupBy("block", "shard")
    found = left.cogroup(right).applyInPandas(lambda q, v: search_shard(q, v, k), SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
