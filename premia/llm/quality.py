"""Text quality by votes of the nearest labelled texts in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from premia.llm.common import small_batches, stored, text_of

PER_LABEL = 2048
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8
KEEP_FROM = 0.7
SLOTS = 4096
STEPS = 32
REPEAT_SHARE = 0.5
CHUNK = 1 << 20
LETTER, CAPITAL, DIGIT, BLANK, LINE = range(5)
SIGN = 5
CLASSES = SIGN + 32


def _classes() -> np.ndarray:
    """Class of each byte: letters (all bytes beyond ASCII too), capitals, digits, blanks, line ends, each sign by itself."""
    out = np.full(256, BLANK, np.int64)
    out[0x80:] = LETTER
    out[ord("a"):ord("z") + 1] = LETTER
    out[ord("A"):ord("Z") + 1] = CAPITAL
    out[ord("0"):ord("9") + 1] = DIGIT
    out[ord("\n")] = LINE
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[signs] = SIGN + np.arange(len(signs))
    return out


_CLASS = _classes()


def shape_terms(text: bytes) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a whole text's shape: one sign for each run of letters, digits or blanks."""
    out = np.zeros(SLOTS)
    last = np.array([LINE])
    for at in range(0, len(text) + 1, CHUNK):
        part = _CLASS[np.frombuffer(text[at:at + CHUNK], np.uint8)]
        if at + CHUNK > len(text):
            part = np.append(part, LINE)
        shape = np.concatenate([last, part])
        start = len(last)
        run = np.append(True, (shape[1:] != shape[:-1]) | (shape[1:] >= LINE))
        run[:start] = True
        shape, new = shape[run], int(run[start:].sum())
        for n in (1, 2, 3):
            first = max(len(shape) - new - n + 1, 0)
            many = len(shape) - n + 1 - first
            if many > 0:
                code = np.zeros(many, np.int64)
                for j in range(n):
                    code = code * CLASSES + shape[first + j:first + j + many]
                out += np.bincount(((code * 3 + n) * 0x9E3779B1 % (1 << 32)) >> 20, minlength=SLOTS)
        last = shape[-2:]
    return out


def repeat_terms(text: bytes) -> np.ndarray:
    """Where the shares of different words and of different lines lie, each dealt to the two nearest of ``STEPS`` marks."""
    out = np.zeros(2 * STEPS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    for block, items in enumerate((text.split(), lines)):
        if items:
            place = len(set(items)) / len(items) * (STEPS - 1)
            low = min(int(place), STEPS - 2)
            out[block * STEPS + low] += 1 - (place - low)
            out[block * STEPS + low + 1] += place - low
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass
class Space:
    """Term weights, latent directions, labelled vectors, their labels and how many labelled rows each stands for."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    good: np.ndarray
    stands: np.ndarray

    def place(self, texts: list[bytes]) -> np.ndarray:
        """Unit vectors of whole texts."""
        return unit(weighed(np.stack([terms(t) for t in texts]), self.weights) @ self.directions)

    def scores(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        """Share of the label 1 among the nearest labelled rows, each weighed by its similarity.

        Every cosine is computed, a block of texts at a time. Ties go to the row that was drawn first.
        """
        if not len(self.good):
            return np.full(len(texts), 0.5)
        out = [np.zeros(0)]
        for at in range(0, len(texts), block):
            close = np.round(self.place(texts[at:at + block]) @ self.vectors.T, 9)
            k = min(NEIGHBOURS, close.shape[1])
            cut = np.partition(close, close.shape[1] - k, axis=1)[:, close.shape[1] - k, None]
            above, level = close > cut, close == cut
            chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
            vote = np.where(chosen, np.maximum(close, 0) ** SHARPNESS * self.stands, 0)
            total = vote.sum(axis=1)
            prior = float((self.good * self.stands).sum() / self.stands.sum())
            out.append(np.where(total > 0, (vote @ self.good) / np.where(total > 0, total, 1), prior))
        return np.clip(np.round(np.concatenate(out), 6), 0, 1)


def terms(text: bytes) -> np.ndarray:
    return np.concatenate([shape_terms(text), repeat_terms(text)])


def weighed(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit rows: roots of the shape terms' shares by their weights, beside the repeat terms."""
    shape = counts[:, :SLOTS]
    shape = unit(np.sqrt(shape / np.maximum(shape.sum(axis=1, keepdims=True), 1)) * weights)
    return unit(np.hstack([shape, REPEAT_SHARE * counts[:, SLOTS:]]))


def directions(rows: np.ndarray, rank: int, seed: int = 5, turns: int = 6) -> np.ndarray:
    """The strongest ``rank`` latent directions of the rows, by seeded subspace iteration."""
    rank = min(rank, *rows.shape)
    basis = np.linalg.qr(rows.T @ np.random.default_rng(seed).standard_normal((len(rows), rank)))[0]
    for _ in range(turns):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    return basis @ np.linalg.svd(rows @ basis, full_matrices=False)[2].T


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(t) for t in batch.column("text").to_pylist()]
        places = [np.flatnonzero(f) for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("draw"), batch.column("good"), batch.column("stands"),
             pa.array([p.tolist() for p in places], pa.list_(pa.int32())),
             pa.array([f[p].tolist() for f, p in zip(found, places)], pa.list_(pa.float64()))],
            ["draw", "good", "stands", "places", "counts"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, where: Column,
          per_label: int = PER_LABEL, rank: int = RANK) -> Space:
    """The space and its labelled vectors, from at most ``per_label`` ids with the label 1 and as many with another.

    ``where`` chooses the ids that may be learned from. Ids are drawn by a hash, in each task first; null labels and
    ids without a document go before. An id's row stands for its label's share of all labelled ids. If documents
    repeat an id, the first text in byte order counts. The driver sees the sampled texts' term counts, no more.
    """
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & where).select(
        F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("double").alias("good")).distinct()
    known = marked.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").withColumn("draw", F.xxhash64("id", F.lit(13)))
    known = stored(known, "quality-labels")
    sizes = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    lot = Window.partitionBy("good").orderBy("draw", "id")
    # The draw is even over 64 bits: a quarter more than are wanted passes, so few rows of a label are ranked.
    many = F.when(F.col("good") == 1, F.lit(max(sizes.get(1.0, 0), 1))).otherwise(F.lit(max(sizes.get(0.0, 0), 1)))
    low = F.col("draw").cast("double") < -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), (1.25 * per_label + 100) / many)
    drawn = (known.filter(low | (many <= per_label)).withColumn("place", F.row_number().over(lot)).filter(F.col("place") <= per_label)
             .withColumn("stands", F.when(F.col("good") == 1, F.lit(max(sizes.get(1.0, 0) / per_label, 1.0)))
                         .otherwise(F.lit(max(sizes.get(0.0, 0) / per_label, 1.0)))))
    texts = (docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
             .join(F.broadcast(stored(drawn, "quality-drawn")), "id")
             .groupBy("id", "draw", "good", "stands").agg(F.min("text").alias("text")))
    rows = sorted(texts.select("draw", "good", "stands", "text").mapInArrow(
        _sparse, "draw long, good double, stands double, places array<int>, counts array<double>").collect(),
        key=lambda r: (r["draw"], r["good"]))
    counts = np.zeros((len(rows), SLOTS + 2 * STEPS))
    for i, row in enumerate(rows):
        counts[i, row["places"]] = row["counts"]
    weights = np.log((1 + len(rows)) / (1 + (counts[:, :SLOTS] > 0).sum(axis=0))) + 1
    good, stands = (np.array([r[c] for r in rows], dtype=float) for c in ("good", "stands"))
    if not rows:
        return Space(weights, np.zeros((SLOTS + 2 * STEPS, 1)), np.zeros((0, 1)), good, stands)
    placed = weighed(counts, weights)
    latent = directions(placed, rank)
    return Space(weights, latent, unit(placed @ latent), good, stands)


def held_out(id_col: str) -> Column:
    """Ids kept for testing: crc32 of the id as text leaves 2 when divided by four. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", per_label: int = PER_LABEL, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (likelihood of the label 1), ``predicted``.

    Scores depend on the text alone: its shape, repeated words and lines are placed in the latent space and the nearest of
    the labelled vectors vote. A null text is empty; an empty text is placed like any other. If it has no
    neighbour on its side, the share of the label 1 is its score; without labels every score is 0.5.
    Repeated rows are judged each; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    space = spark.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col, ~held_out(id_col), per_label))

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(space.value.scores(list(texts)))

    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(text_of(text_col).cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))
