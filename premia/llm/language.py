"""Language identification with error-correcting output codes over character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from premia.llm.common import fresh, small_batches, stored

UNKNOWN = "und"
SLOTS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 4000
CHUNK = 1 << 18
SURE = 0.55
#: Multipliers of the hashed n-grams, one for each place and order.
_MIX = np.array([[0x9E3779B1, 0, 0], [0x85EBCA77, 0xC2B2AE3D, 0], [0x27D4EB2F, 0x165667B1, 0xD3A2646D]], dtype=np.uint32)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


_ALPHA = _letters()


def code_points(text: str) -> np.ndarray:
    """Lower-case letters of a text, every run of other signs as one blank, with a blank at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = points > 0xFFFF
    letter = _ALPHA[np.where(high, 0, points)]
    if high.any():
        letter[high] = [chr(c).isalpha() for c in points[high]]
    points = np.where(letter, points, np.uint32(32))
    return points[letter | np.append(True, letter[:-1])]


def grams(points: np.ndarray) -> np.ndarray:
    """Slots of all n-grams of a text."""
    out = []
    for n in ORDERS:
        if len(points) >= n:
            h = np.zeros(len(points) - n + 1, np.uint32)
            for j in range(n):
                h += points[j:len(points) - n + 1 + j] * _MIX[n - 1][j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append(h >> np.uint32(32 - SLOTS.bit_length() + 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """One row of -1 / +1 per language: all splits for up to five, else the best of some seeded codes."""
    if languages <= 5:
        splits = range(1, 1 << (languages - 1)) if languages > 1 else []
        return np.array([[1 if (b >> i) & 1 else -1 for b in splits] for i in range(languages)], np.int8).reshape(languages, len(splits))
    rng = np.random.default_rng(seed)
    length = math.ceil(10 * math.log2(languages))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, length))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        near = code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(near, -length)
        gap = (code.shape[1] - near.max()) // 2
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass
class Codebook:
    """Languages, their codewords, each bit's weight for each slot, and how well each bit knows each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str | None) -> np.ndarray | None:
        """What the bits' classifiers say of a whole text: mean log odds of its n-grams; None without a letter."""
        if not text:
            return None
        points = code_points(text)
        if not (points != 32).any():
            return None
        total, n = np.zeros(self.code.shape[1]), 0
        for at in range(0, len(points), CHUNK):
            slots = grams(points[at:at + CHUNK + max(ORDERS) - 1])
            total += np.bincount(slots, minlength=SLOTS) @ self.weights if len(slots) > SLOTS else self.weights[slots].sum(axis=0, dtype=np.float64)
            n += len(slots)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray | None) -> tuple[str, float, bool]:
        """Language, score and ambiguity: the codeword with the least loss, each bit weighed by its trust."""
        if margins is None or not self.languages:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = (self.trust * np.exp(np.clip(-self.code * margins, -30, 30))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        score = float(loss[order[1]] / (loss[order[0]] + loss[order[1]]))
        return self.languages[order[0]], score, score < SURE


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            points = code_points(text)
            own = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
            for at in range(0, len(points), CHUNK):
                own += np.bincount(grams(points[at:at + CHUNK + max(ORDERS) - 1]), minlength=SLOTS)
    for lang, own in counts.items():
        slots = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(slots), "slot": slots.astype(np.int32), "n": own[slots]})


def learn(docs: DataFrame, text_col: str, lang_col: str, where: Column, per_language: int = PER_LANGUAGE) -> Codebook:
    """Fit the binary classifiers on about ``per_language`` rows of each language that satisfy ``where``.

    Rows are chosen by a hash of the text, each language with the share that gives the bound. Spark adds up
    n-gram counts by language; a bit's weight for an n-gram is the log ratio of its share in the languages on
    either side. The driver sees one number for each language and slot, never a text.
    """
    rows = docs.filter(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1_000_000)) < F.col("share") * 1_000_000
    sample = stored(rows.join(F.broadcast(share), "lang").filter(drawn).select("lang", "text"), "language-sample")
    counted = (sample.mapInArrow(_count_grams, "lang string, slot int, n long")
               .groupBy("lang", "slot").agg(F.sum("n").alias("n"))).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((len(languages), SLOTS))
    counts[pd.Categorical(counted["lang"], languages).codes, counted["slot"]] = counted["n"]
    shares = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * SLOTS)
    code = codewords(len(languages))
    up = (code > 0).astype(float)
    weights = np.log((up.T @ shares) / np.maximum(up.sum(axis=0), 1)[:, None]) - np.log(
        ((1 - up).T @ shares) / np.maximum((1 - up).sum(axis=0), 1)[:, None])
    book = Codebook(languages, code, np.ascontiguousarray(weights.T.astype(np.float32)), np.ones(code.shape))
    if code.size:
        book.trust = _trust(sample, book)
    return book


def _trust(sample: DataFrame, book: Codebook) -> np.ndarray:
    """How often each bit is right on the sampled texts of each language, each row adding up to one."""

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(book.languages)}
        good, n = np.zeros(book.code.shape), np.zeros(len(place))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                margins = book.margins(text)
                if margins is not None:
                    good[place[lang]] += margins * book.code[place[lang]] > 0
                    n[place[lang]] += 1
        at, bit = np.indices(good.shape)
        yield pa.RecordBatch.from_pydict({"at": at.ravel(), "bit": bit.ravel(), "good": good.ravel(), "n": n[at].ravel()})

    summed = (sample.mapInArrow(right, "at long, bit long, good double, n double")
              .groupBy("at", "bit").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))).toPandas()
    trust = np.ones(book.code.shape)
    trust[summed["at"], summed["bit"]] = (summed["good"] + 1) / (summed["n"] + 2)
    return trust / trust.sum(axis=1, keepdims=True)


def identify(text: Column, book: Codebook) -> Column:
    """Struct (lang_pred, score, ambiguous) of each whole text."""

    @pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([book.decode(book.margins(t)) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return predict(text)


def held_out(id_col: str) -> Column:
    """Rows kept for testing: crc32 of the id as text is divisible by five. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``, ``ambiguous``.

    Learns only from rows that are not held out and whose language is known. A text that is null or has no letter is
    ``und`` with score 0, as is everything if no row has a language. The score is the runner-up's
    share of the two least losses: 0.5 for a tie, which goes to the language first in the alphabet, up to 1.
    Repeated rows are judged each; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    book = learn(docs, text_col, lang_col, ~held_out(id_col))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"),
                       identify(F.col(text_col).cast("string"), book).alias("p")).select(
        id_col, "held_out", "p.lang_pred", "p.score", "p.ambiguous")


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the texts that have no language: no letter at all, or as near to two languages."""
    small_batches(docs.sparkSession)
    book = learn(docs, text_col, lang_col, ~held_out(id_col))
    said = fresh(docs, "said")
    return (docs.withColumn(said, identify(F.col(text_col).cast("string"), book))
            .filter(f"{said}.lang_pred <> '{UNKNOWN}' AND NOT ({said}.score <= 0.5)").select(docs.columns))
