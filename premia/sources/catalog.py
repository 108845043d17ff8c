"""The asset catalog: registration, publishing, listing, resolving."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from premia.operators.rowids import with_row_id


def newest_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """The last row of each key along ``order_by``, which must be a total order within a key.

    An aggregate, not a window: every task first keeps one row per key, so a key that holds a
    third of the table is never gathered.
    """
    others = [c for c in df.columns if c not in keys and c not in order_by]
    newest = F.max_by(F.struct(*order_by, *others) if others else F.struct(*order_by),
                      F.struct(*order_by))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def register_assets(incoming: DataFrame, catalog: DataFrame, requeue: bool = False) -> DataFrame:
    """Decide for each upload whether it is new, already there, or to be queued again.

    ``incoming``: upload_id, tenant_id, file_hash, submitted_at. ``catalog``: asset_id, tenant_id,
    file_hash, upload_status, is_active, created_at, and with ``requeue`` also file_exists.

    The newest active, not failed asset of the same tenant and hash is reused. Without one, the
    first such upload of the batch becomes a new pending asset, which the later ones then find.
    ``requeue`` queues a reused asset again when it is not ready and its file is still there.
    An upload without a tenant or hash gets no asset: action ``refuse``, status ``no_fingerprint``.
    """
    key = ["tenant_id", "file_hash"]
    exists = F.col("file_exists") if requeue else F.lit(False)
    live = (
        catalog.filter(F.col("is_active") & (F.col("upload_status") != "failed"))
        .groupBy(*key)
        .agg(F.max(F.struct("created_at", "asset_id", "upload_status",
                            exists.alias("file_exists"))).alias("known"))
    )
    first = incoming.groupBy(*key).agg(
        F.min(F.struct("submitted_at", "upload_id")).alias("first"))
    # one row per (tenant, hash) on both sides; the uploads themselves join only once
    decided = first.join(live, key, "left").select(*key, "first", "known")
    is_known = F.col("known").isNotNull()
    is_first = F.col("first.upload_id") == F.col("upload_id")
    current = F.when(is_known, F.col("known.upload_status")).otherwise("pending")
    stored = F.when(is_known, F.col("known.file_exists")).otherwise(F.lit(requeue))
    unknown = F.col("tenant_id").isNull() | F.col("file_hash").isNull()
    action = (
        F.when(unknown, "refuse")
        .when(~is_known & is_first, "new")
        .when((current != "ready") & stored, "requeue")
        .otherwise("reuse")
    )
    return (
        incoming.join(decided, key, "left")
        .select(
            "upload_id", *key,
            F.coalesce(F.col("known.asset_id").cast("string"),
                       F.col("first.upload_id").cast("string")).alias("asset_id"),
            action.alias("action"),
            F.when(unknown, "no_fingerprint")
            .when(action != "reuse", "queued")
            .when(current == "ready", "already_exists").otherwise(current).alias("status"),
        )
    )


def apply_registration(catalog: DataFrame, incoming: DataFrame, decided: DataFrame) -> DataFrame:
    """The catalog after a batch: requeued assets pending again, new assets added as pending.

    ``decided`` comes from ``register_assets``. Columns an upload does not have stay null.
    """
    requeued = decided.filter(F.col("action") == "requeue").select("asset_id").distinct()
    requeued = requeued.withColumn("_again", F.lit(True))
    kept = catalog.join(requeued, "asset_id", "left").withColumn(
        "upload_status", F.when(F.col("_again"), "pending").otherwise(F.col("upload_status")))
    new = incoming.join(decided.filter(F.col("action") == "new").select("upload_id", "asset_id"),
                        "upload_id")
    values = {"upload_status": F.lit("pending"), "is_active": F.lit(True),
              "created_at": F.col("submitted_at"), "file_exists": F.lit(True)}
    added = new.select(*[
        values.get(f.name, F.col(f.name) if f.name in new.columns else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in catalog.schema])
    return kept.select(*catalog.columns).unionByName(added)


def record_outcomes(catalog: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The catalog after ingestion: ``outcomes`` has one row per finished asset.

    asset_id, upload_status (ready or failed) and any of the catalog's result columns; a failed
    asset keeps the results it had.
    """
    results = [c for c in outcomes.columns if c in catalog.columns
               and c not in ("asset_id", "upload_status")]
    done = outcomes.select(
        "asset_id", F.col("upload_status").alias("_status"),
        *[F.col(c).alias(f"_{c}") for c in results])
    ready = F.col("_status") == "ready"
    return catalog.join(done, "asset_id", "left").select(*[
        F.coalesce("_status", c).alias(c) if c == "upload_status"
        else F.when(ready, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in results
        else F.col(c) for c in catalog.columns])


def published_table_name(tenant_id: str, dataset_id: str) -> str:
    """``t_<tenant>_<dataset>``, eight digits of each id without dashes."""
    return f"t_{tenant_id.replace('-', '')[:8]}_{dataset_id.replace('-', '')[:8]}"


def publish_dataset(df: DataFrame, tenant_id: str, dataset_id: str, keep: int = 1) -> str:
    """Publish a dataset with row ids under the tenant's table name, replacing an older one; returns the name.

    The rows become a table of their own first; then the name, a view, is switched to it in one step. A
    reader sees the whole old or the whole new version, a job that fails leaves the old one as it was, and a dataset
    may be made from its own published rows. The ``keep`` versions before stay for jobs that still read them. Two
    jobs that publish one dataset at once both succeed; the later switch wins.
    """
    spark = df.sparkSession
    name = published_table_name(tenant_id, dataset_id)
    version = f"{name.lower()}_v{time.time_ns():020d}_{uuid.uuid4().hex[:8]}"
    with_row_id(df).write.saveAsTable(version)
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE `{name}`")  # published before there were versions
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM `{version}`")
    older = [v for v in published_versions(spark, name) if v < version]
    for old in older[:max(0, len(older) - keep)]:
        spark.sql(f"DROP TABLE IF EXISTS `{old}`")
    return name


def published_versions(spark: SparkSession, name: str) -> list[str]:
    """The stored versions of a published table, oldest first."""
    found = [t.name for t in spark.catalog.listTables(pattern=f"{name}_v*")]
    return sorted(t for t in found if re.fullmatch(r"\d{20}_[0-9a-f]{8}", t[len(name) + 2:]))


def withdraw_dataset(spark: SparkSession, tenant_id: str, dataset_id: str) -> None:
    """Take a published dataset away, with all its versions. One that was never published is no error."""
    name = published_table_name(tenant_id, dataset_id)
    spark.sql(f"DROP VIEW IF EXISTS `{name}`")
    for version in published_versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS `{version}`")


def list_assets(catalog: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """Active assets, of one tenant or of all."""
    active = catalog.filter(F.col("is_active"))
    if tenant_id is not None:
        active = active.filter(F.col("tenant_id") == tenant_id)
    kept = ["tenant_id", "asset_id", "kind", "original_filename", "upload_status", "row_count",
            "column_count", "chunk_count", "page_count", "created_at"]
    return active.select(*[c for c in kept if c in catalog.columns])


def set_column_tags(catalog: DataFrame, asset_id: str, tags: Mapping[str, str]) -> DataFrame:
    """Replace the whole tag map of one dataset."""
    pairs = [F.lit(x) for item in tags.items() for x in item]
    new = F.create_map(*pairs).cast("map<string,string>")
    return catalog.withColumn(
        "column_tags", F.when(F.col("asset_id") == asset_id, new).otherwise(F.col("column_tags")))


def workspace_kpis(catalog: DataFrame) -> DataFrame:
    """Ready datasets, ready documents and their chunks, per tenant."""
    ready = (F.col("upload_status") == "ready") & F.col("is_active")
    document = ready & (F.col("kind") == "document")
    return catalog.groupBy("tenant_id").agg(
        F.count_if(ready & (F.col("kind") == "dataset")).alias("ready_datasets"),
        F.count_if(document).alias("ready_documents"),
        F.coalesce(F.sum(F.when(document, F.coalesce("chunk_count", F.lit(0)))), F.lit(0))
        .cast("bigint").alias("total_chunks"),
    )


def canonical_id(value: Column) -> Column:
    """A UUID in any accepted spelling as 32 lower-case hex digits; null if malformed."""
    bare = F.regexp_replace(F.lower(value), "urn:|uuid:", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[{}]+|[{}]+$", ""), "-", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def resolve_datasets(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per request the usable datasets it names, in the order it names them.

    ``requests``: request_id, tenant_id, dataset_ids. ``catalog``: asset_id, tenant_id,
    upload_status, table_name, has_schema, row_count. Malformed, foreign, unready and unpublished
    ids drop out silently. The ids listed in a request bound its group.
    """
    named = requests.select(
        "request_id", "tenant_id", F.posexplode_outer("dataset_ids").alias("position", "raw")
    ).withColumn(
        # a malformed id gets a key of its own, so that they do not pile up under one null key
        "canonical", F.coalesce(canonical_id(F.col("raw")), F.concat(F.lit("~"), "request_id")))
    usable = catalog.filter(
        (F.col("upload_status") == "ready") & (F.col("table_name") != "") & F.col("has_schema")
    ).select(canonical_id(F.col("asset_id")).alias("canonical"), "tenant_id", "table_name",
             "row_count")
    hit = F.when(F.col("table_name").isNotNull(), F.struct("position", "table_name", "row_count"))
    return (
        named.join(usable, ["canonical", "tenant_id"], "left")
        .groupBy("request_id")
        .agg(F.first("tenant_id").alias("tenant_id"),
             F.sort_array(F.collect_list(hit)).alias("datasets"))
    )
