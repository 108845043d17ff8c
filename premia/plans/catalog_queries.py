"""Queries over uploads, the asset catalog and column profiles."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from premia.functions.tenancy import tenant_id_of
from premia.operators.governed_sql import schema_context
from premia.operators.profile import column_facts, profile_columns, sample_values
from premia.operators.rowids import with_row_id
from premia.plans.registry import query
from premia.plans.tables import (
    DATASET_CATALOG_SQL, DOCUMENT_CATALOG_SQL, UPLOADS_SQL, dataset_catalog, dataset_requests,
    document_catalog, table, uploads,
)
from premia.session import spread
from premia.sources.catalog import (
    apply_registration, list_assets, newest_per_key, publish_dataset, published_versions, record_outcomes,
    register_assets, resolve_datasets, withdraw_dataset, workspace_kpis,
)
from premia.sources.tabular import fingerprint_files, screen_uploads

_LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
             ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
             ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
             ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
             ("c_acctbal", "double"), ("c_mktsegment", "string")]


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    """Column profile of a table in SQL, one SELECT per column."""
    parts = []
    for i, (c, dtype) in enumerate(columns):
        if dtype in ("bigint", "int", "double"):
            stats = ", ".join(
                f"round({e}, 4) AS {a}" for e, a in (
                    (f"avg({c}::double)", "mean"), (f"stddev_samp({c}::double)", "std"),
                    (f"min({c}::double)", "min"), (f"max({c}::double)", "max"),
                    (f"quantile_cont({c}::double, 0.25)", "p25"),
                    (f"quantile_cont({c}::double, 0.5)", "p50"),
                    (f"quantile_cont({c}::double, 0.75)", "p75")))
            fence = (f"(SELECT quantile_cont({c}::double, 0.25) AS q1, "
                     f"quantile_cont({c}::double, 0.75) AS q3 FROM {name})")
            outliers = (f"(SELECT count(*) FROM {name}, {fence} f WHERE {c} < q1 - 1.5 * (q3 - q1) "
                        f"OR {c} > q3 + 1.5 * (q3 - q1))")
        else:
            stats = ", ".join(f"NULL::double AS {a}" for a in
                              ("mean", "std", "min", "max", "p25", "p50", "p75"))
            outliers = "NULL::bigint"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, '{dtype}' AS dtype, "
            f"count(*) AS row_count, {len(columns)} AS column_count, "
            f"count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2)::double AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count, {stats}, {outliers} AS outlier_count "
            f"FROM {name}")
    return "\nUNION ALL\n".join(parts)


def _spread_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_shipdate")


@query("column_profile", _profile_sql("lineitem", _LINEITEM))
def _column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_columns(_spread_items(spark, sf_dir))


@query("column_profile_customer", _profile_sql("customer", _CUSTOMER))
def _column_profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_columns(table(spark, sf_dir, "customer"))


@query("column_profile_sketched")
def _column_profile_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_columns(_spread_items(spark, sf_dir), approx=True)


def _schema_sql(name: str, columns: list[tuple[str, str]]) -> str:
    listed = ", ".join(f"{c} ({dtype})" for c, dtype in columns)
    return f"""
    SELECT '{name}' AS table_name, 'Table: {name}' || chr(10) || 'Columns: {listed}' || chr(10)
           || 'Row count: ' || count(*) AS schema_text
    FROM {name}
    """


@query("schema_context", _schema_sql("lineitem", _LINEITEM) + "UNION ALL" + _schema_sql("customer", _CUSTOMER))
def _schema_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = [column_facts(table(spark, sf_dir, name), name) for name in ("lineitem", "customer")]
    return schema_context(facts[0].unionByName(facts[1]))


@query("sample_values", """
    WITH firsts AS (
        SELECT 'p_name' AS column_name, p_name AS value, min(p_partkey) AS seen
        FROM part GROUP BY ALL
        UNION ALL SELECT 'p_brand', p_brand, min(p_partkey) FROM part GROUP BY ALL
        UNION ALL SELECT 'p_type', p_type, min(p_partkey) FROM part GROUP BY ALL)
    SELECT column_name, row_number() OVER w AS rank, value FROM firsts
    WINDOW w AS (PARTITION BY column_name ORDER BY seen, value)
    QUALIFY row_number() OVER w <= 5
""")
def _sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_values(table(spark, sf_dir, "part"), "p_partkey")


@query("publish_dataset", """
    SELECT c_custkey, c_name, c_nationkey, round(c_acctbal * 2, 2) AS balance, 2 AS versions
    FROM customer
""")
def _publish_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are published three times, the second time from their own rows; the third job fails midway."""
    ids = ("customers", "balances")
    first = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    withdraw_dataset(spark, *ids)
    name = publish_dataset(first, *ids)
    publish_dataset(spark.table(name).select(
        "c_custkey", "c_name", "c_nationkey", F.round(F.col("c_acctbal") * 2, 2).alias("balance")), *ids)
    broken = F.when(F.col("c_custkey") % 2 == 0, F.raise_error(F.lit("cannot be read"))).otherwise("lost")
    try:
        publish_dataset(spark.table(name).withColumn("c_name", broken), *ids)
    except PySparkException:
        pass  # the version before stays
    # counted before the result is read, and so a fixed value of the plan
    stored = len(published_versions(spark, name))
    return spark.table(name).select(
        "c_custkey", "c_name", "c_nationkey", "balance", F.lit(stored).alias("versions"))


@query("row_ids", """
    WITH marked AS (
        SELECT l_suppkey, l_returnflag, l_linestatus,
               sha256('{"l_suppkey":' || l_suppkey || ',"l_returnflag":"' || l_returnflag
                      || '","l_linestatus":"' || l_linestatus || '"}') AS digest
        FROM lineitem)
    SELECT *, digest || '-' || (row_number() OVER (PARTITION BY digest) - 1) AS _row_id FROM marked
""")
def _row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ids; three columns, so that rows repeat (whole line items do not)."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    made = with_row_id(rows)
    return made.withColumn("digest", F.substring_index("_row_id", "-", 1))


_SCREENED_SQL = f"""
    SELECT *, CASE
        WHEN lower(regexp_extract(original_filename, '[^/]\\.([^./]+)$', 1))
             NOT IN ('pdf', 'csv', 'xlsx', 'xls') THEN 'file_type_not_allowed'
        WHEN file_size_bytes > 52428800 THEN 'file_too_large' END AS reason
    FROM ({UPLOADS_SQL}) u
"""


@query("screen_uploads", f"""
    SELECT upload_id, original_filename, file_size_bytes, reason, reason IS NULL AS accepted
    FROM ({_SCREENED_SQL}) s
""")
def _screen_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen_uploads(uploads(spark, sf_dir)).select(
        "upload_id", "original_filename", "file_size_bytes", "reason", "accepted")


def _register_sql(requeue: bool) -> str:
    """Registration by a per-upload lookup and a count of earlier equal uploads."""
    stored = "k.file_exists" if requeue else "false"
    again = "true" if requeue else "false"
    return f"""
    WITH incoming AS (SELECT * FROM ({_SCREENED_SQL}) s WHERE reason IS NULL),
    live AS (
        SELECT * FROM ({DOCUMENT_CATALOG_SQL}) c WHERE is_active AND upload_status <> 'failed'
        QUALIFY row_number() OVER (PARTITION BY tenant_id, file_hash
                                   ORDER BY created_at DESC, asset_id DESC) = 1),
    ordered AS (
        SELECT *, first_value(upload_id) OVER (PARTITION BY tenant_id, file_hash
                                               ORDER BY submitted_at, upload_id) AS first_id
        FROM incoming),
    decided AS (
        SELECT o.upload_id, o.tenant_id, o.file_hash,
               coalesce(k.asset_id, o.first_id::varchar) AS asset_id,
               CASE WHEN k.asset_id IS NULL AND o.first_id = o.upload_id THEN 'new'
                    WHEN coalesce(k.upload_status, 'pending') <> 'ready'
                         AND (CASE WHEN k.asset_id IS NULL THEN {again} ELSE {stored} END)
                    THEN 'requeue' ELSE 'reuse' END AS action,
               coalesce(k.upload_status, 'pending') AS current
        FROM ordered o LEFT JOIN live k USING (tenant_id, file_hash))
    SELECT upload_id, tenant_id, file_hash, asset_id, action,
           CASE WHEN action <> 'reuse' THEN 'queued' WHEN current = 'ready' THEN 'already_exists'
                ELSE current END AS status
    FROM decided
    """


@query("register_assets", _register_sql(False))
def _register_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = screen_uploads(uploads(spark, sf_dir)).filter("accepted")
    return register_assets(incoming, document_catalog(spark, sf_dir))


@query("register_assets_requeue", _register_sql(True))
def _register_assets_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = screen_uploads(uploads(spark, sf_dir)).filter("accepted")
    return register_assets(incoming, document_catalog(spark, sf_dir), requeue=True)


@query("catalog_after_ingest", f"""
    WITH decided AS ({_register_sql(True)}),
    registered AS (
        SELECT asset_id, tenant_id, original_filename, file_hash,
               CASE WHEN asset_id IN (SELECT asset_id FROM decided WHERE action = 'requeue')
                    THEN 'pending' ELSE upload_status END AS upload_status,
               is_active, created_at, chunk_count
        FROM ({DOCUMENT_CATALOG_SQL}) c
        UNION ALL
        SELECT d.asset_id, d.tenant_id, u.original_filename, d.file_hash, 'pending', true,
               u.submitted_at, NULL
        FROM decided d JOIN ({UPLOADS_SQL}) u USING (upload_id) WHERE action = 'new'),
    outcome AS (
        SELECT doc_id::varchar AS asset_id, n_chars > 900 AS good, n_chars // 500 AS chunk_count
        FROM documents)
    SELECT r.asset_id, tenant_id, original_filename, file_hash,
           CASE WHEN good THEN 'ready' WHEN NOT good THEN 'failed' ELSE upload_status END
               AS upload_status,
           is_active, created_at,
           CASE WHEN good THEN o.chunk_count ELSE r.chunk_count END AS chunk_count
    FROM registered r LEFT JOIN outcome o USING (asset_id)
""")
def _catalog_after_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads registered, then the new ones ingested: long documents work, short ones fail."""
    incoming = screen_uploads(uploads(spark, sf_dir)).filter("accepted")
    catalog = document_catalog(spark, sf_dir)
    decided = register_assets(incoming, catalog, requeue=True)
    outcomes = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("asset_id"),
        F.when(F.col("n_chars") > 900, "ready").otherwise("failed").alias("upload_status"),
        F.floor(F.col("n_chars") / 500).alias("chunk_count"))
    after = record_outcomes(apply_registration(catalog, incoming, decided), outcomes)
    return after.select("asset_id", "tenant_id", "original_filename", "file_hash",
                        "upload_status", "is_active", "created_at", "chunk_count")


@query("fingerprint_files")
def _fingerprint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the data folder themselves; SQL over the tables cannot see their bytes."""
    return fingerprint_files(spark, sf_dir).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "file_size_bytes", "file_hash")


@query("newest_per_key", """
    SELECT user_id, event_type, ts, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type
                               ORDER BY ts DESC, event_id DESC) = 1
""")
def _newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", "ts", "event_id", "value")
    return newest_per_key(events, ["user_id", "event_type"], ["ts", "event_id"])


@query("list_assets", f"""
    SELECT tenant_id, asset_id, kind, original_filename, upload_status, chunk_count, created_at
    FROM ({DOCUMENT_CATALOG_SQL}) c WHERE is_active
""")
def _list_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_assets(document_catalog(spark, sf_dir))


@query("workspace_kpis", f"""
    SELECT tenant_id,
           count(*) FILTER (is_active AND upload_status = 'ready' AND kind = 'dataset')
               AS ready_datasets,
           count(*) FILTER (is_active AND upload_status = 'ready' AND kind = 'document')
               AS ready_documents,
           coalesce(sum(chunk_count) FILTER (is_active AND upload_status = 'ready'
                                             AND kind = 'document'), 0)::bigint AS total_chunks
    FROM ({DOCUMENT_CATALOG_SQL}) c GROUP BY tenant_id
""")
def _workspace_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace_kpis(document_catalog(spark, sf_dir))


@query("resolve_datasets", f"""
    WITH requests AS (
        SELECT event_id AS request_id, event_type AS tenant_id,
               unnest([md5('ds' || (props::json ->> 'k')), 'not-an-id', md5('ds' || user_id)])
                   AS id,
               unnest([0, 1, 2]) AS position
        FROM events),
    hits AS (
        SELECT request_id, position, table_name, row_count
        FROM requests JOIN ({DATASET_CATALOG_SQL}) c ON id = asset_id
             AND requests.tenant_id = c.tenant_id
        WHERE upload_status = 'ready' AND has_schema)
    SELECT event_id AS request_id, event_type AS tenant_id,
           coalesce(string_agg(table_name, ',' ORDER BY position), '') AS tables,
           count(table_name) AS n
    FROM events LEFT JOIN hits ON event_id = request_id GROUP BY ALL
""")
def _resolve_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_datasets(dataset_requests(spark, sf_dir), dataset_catalog(spark, sf_dir))
    return found.select(
        "request_id", "tenant_id", F.array_join("datasets.table_name", ",").alias("tables"),
        F.size("datasets").cast("bigint").alias("n"))


@query("tenant_ids", """
    SELECT c_custkey, substr(sha256('key-' || c_name), 1, 16) AS tenant_id FROM customer
""")
def _tenant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tenant_id_of(F.concat(F.lit("key-"), "c_name")).alias("tenant_id"))
