"""Tenant identity and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tenant_id_of(api_key: Column) -> Column:
    """First 16 hex digits of the key's SHA-256."""
    return F.substring(F.sha2(api_key.cast("binary"), 256), 1, 16)


def scope_to_tenant(df: DataFrame, tenant_id: str) -> DataFrame:
    """Rows of one tenant; a plain equality, so it reaches the scan or prunes partitions."""
    return df.filter(F.col("tenant_id") == F.lit(tenant_id))


def scope_chunks(
    chunks: DataFrame, tenant_id: str, documents: list[str] | DataFrame | None = None
) -> DataFrame:
    """Chunks of a tenant, optionally of some documents; an empty list is no document filter.

    A list becomes a pushed-down ``IN``; for long lists pass a DataFrame with ``document_id``,
    which becomes a semi join.
    """
    scoped = scope_to_tenant(chunks, tenant_id)
    if documents is None:
        return scoped
    if isinstance(documents, DataFrame):
        return scoped.join(documents.select("document_id"), "document_id", "left_semi")
    if not documents:
        return scoped
    if len(documents) == 1:
        return scoped.filter(F.col("document_id") == documents[0])
    return scoped.filter(F.col("document_id").isin(list(documents)))
