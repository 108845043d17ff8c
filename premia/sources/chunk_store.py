"""The chunk store: replace the chunks of re-uploaded documents, find stale embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def replace_document_chunks(store: DataFrame, new: DataFrame,
                            documents: DataFrame | None = None) -> DataFrame:
    """``store`` with all chunks of the re-uploaded documents replaced by ``new``.

    ``documents`` (document_id) lists the re-uploaded documents; one that yields no chunk any more
    still loses its old ones. Without it the documents in ``new`` are taken.
    """
    replaced = (documents if documents is not None else new).select("document_id").distinct()
    kept = store.join(replaced, "document_id", "left_anti")
    return kept.select(*store.columns).unionByName(new.select(*store.columns))


def stale_embeddings(store: DataFrame, model: str) -> DataFrame:
    """Chunks whose vectors were made by another model, or have none."""
    return store.filter(~F.col("embedding_model").eqNullSafe(F.lit(model)))
