"""Hooks for outside models, as column functions.

A model is loaded once per task, inside the worker, and fed Arrow batches; nothing passes
through the driver. Each loader returns a callable on plain Python lists. The number of tasks
that hold a model at once is the number of partitions of the stage, so ``coalesce`` the input
to cap concurrency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from premia.settings import EMBED_BATCH


def _slices(items: list, size: int) -> Iterator[list]:
    for start in range(0, len(items), size):
        yield items[start:start + size]


def text_model(load: Callable[[], Callable[[list[str]], list]], returns: str = "string",
               batch: int = EMBED_BATCH):
    """Column function ``text -> returns``: embedding, generation, summaries."""

    @F.pandas_udf(returns)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list = []
            for part in _slices(texts.tolist(), batch):
                out.extend(model(part))
            yield pd.Series(out, index=texts.index, dtype=object)

    return apply


def embedder(load: Callable[[], Callable[[list[str]], list]], batch: int = EMBED_BATCH):
    """Column function ``text -> array<float>``."""
    return text_model(load, "array<float>", batch)


def pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]],
                batch: int = 32):
    """Column function ``(question, text) -> double``."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for questions, texts in batches:
            pairs = list(zip(questions.tolist(), texts.tolist()))
            out: list[float] = []
            for part in _slices(pairs, batch):
                out.extend(model(part))
            yield pd.Series(out, index=questions.index, dtype="float64")

    return apply
