import hashlib
import random

import pytest

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from premia.functions.tenancy import scope_chunks, scope_to_tenant, tenant_id_of
from premia.sources.catalog import (
    apply_registration, canonical_id, newest_per_key, publish_dataset, published_table_name,
    published_versions, record_outcomes, register_assets, resolve_datasets, set_column_tags, withdraw_dataset,
)
from premia.sources.chunk_store import replace_document_chunks, stale_embeddings
from premia.sources.digests import _records
from premia.sources.tabular import fingerprint_files, read_dataset, screen_uploads


def test_read_dataset_types_after_missing_tokens(spark, tmp_path):
    path = tmp_path / "policies.csv"
    path.write_text(
        'id,age,premium,flag,name,when\n'
        '1,30,100.5,True,"Smith, ""J""",2024-01-01\n'
        '2,NA,1e3,false,null,2024-01-02\n'
        '3,41,n/a,TRUE,2d,\n')
    df = read_dataset(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == [
        "bigint", "bigint", "double", "boolean", "string", "string"]
    rows = df.orderBy("id").collect()
    assert rows[0]["name"] == 'Smith, "J"' and rows[1]["age"] is None
    assert rows[1]["premium"] == 1000.0 and rows[2]["premium"] is None and rows[1]["name"] is None


def test_fingerprints_of_files_of_any_size(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2\n")
    (tmp_path / "b.csv").write_bytes(b"z" * 100)
    rows = {r["path"].rsplit("/", 1)[1]: r
            for r in fingerprint_files(spark, str(tmp_path)).collect()}
    assert rows["a.csv"]["file_hash"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    assert rows["b.csv"]["file_hash"] == hashlib.sha256(b"z" * 100).hexdigest()
    assert rows["b.csv"]["file_size_bytes"] == 100


def test_fingerprint_of_a_file_above_2_gb(spark, tmp_path):
    size = 2**31 + 3
    with open(tmp_path / "big.parquet", "wb") as file:  # sparse, so it takes no disk
        file.write(b"head")
        file.seek(size - 4)
        file.write(b"tail")
    [row] = fingerprint_files(spark, str(tmp_path)).collect()
    with open(tmp_path / "big.parquet", "rb") as file:
        assert row["file_hash"] == hashlib.file_digest(file, "sha256").hexdigest()
    assert row["file_size_bytes"] == size


def test_fingerprints_in_blocks(spark, tmp_path):
    block, some = 1 << 20, random.Random(1)
    sizes = {"equal": block, "one more": block + 1, "two": 2 * block, "a,b [1]{x}*?%20é.csv": 3 * block + 12_345,
             "a,b [1]{x}*y%20é.csv": 3 * block + 1, "packed.gz": 2 * block + 7, "[z].gz": 2 * block + 8, "z.gz": 9,
             "_x=1": block + 5, "sub/prime.bin": 5 * block - 3, "long": 17 * block + 65_537}
    (tmp_path / "sub").mkdir()
    bodies = {name: some.randbytes(size) for name, size in sizes.items()}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    rows = fingerprint_files(spark, str(tmp_path), block_bytes=block).collect()
    whole = {r["path"] for r in fingerprint_files(spark, str(tmp_path)).collect()}
    assert len(rows) == len(bodies) and {r["path"] for r in rows} == whole
    got = {r["path"].split(f"{tmp_path}/")[1]: (r["file_size_bytes"], r["file_hash"]) for r in rows}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
    records = _records(spark.sparkContext, str(tmp_path / "long"), block, 1 << 16)
    assert spark.sparkContext.runJob(records, lambda rows: [sum(len(b) for _, b in rows)], list(range(16))) == [block] * 16
    with pytest.raises(ValueError):
        fingerprint_files(spark, str(tmp_path), block_bytes=3 << 20)


def test_screen_uploads(spark):
    names = ["a.CSV", "b.pdf", "c.tar.gz", ".csv", "noext", "d.xlsx", "e..xls"]
    files = spark.createDataFrame([(n, 10) for n in names] + [("big.csv", 2**40)],
                                  "original_filename string, file_size_bytes bigint")
    got = {r["original_filename"]: r["reason"] for r in screen_uploads(files).collect()}
    assert [got[n] is None for n in names] == [True, True, False, False, False, True, True]
    assert got["big.csv"] == "file_too_large" and got["noext"] == "file_type_not_allowed"


def test_registration_keeps_uploads_without_a_hash(spark):
    incoming = spark.createDataFrame([(1, "t", None, 1), (2, "t", "h", 2)],
                                     "upload_id int, tenant_id string, file_hash string, submitted_at int")
    catalog = spark.createDataFrame(
        [], "asset_id string, tenant_id string, file_hash string, upload_status string, is_active boolean, created_at int")
    got = {r["upload_id"]: (r["action"], r["status"], r["asset_id"])
           for r in register_assets(incoming, catalog).collect()}
    assert got == {1: ("refuse", "no_fingerprint", None), 2: ("new", "queued", "2")}


def test_registration(spark):
    incoming = spark.createDataFrame(
        [(1, "t", "h1", 1), (2, "t", "h1", 2), (3, "u", "h1", 3), (4, "t", "h2", 4),
         (5, "t", "h3", 5), (6, "t", "h4", 6), (7, "t", "h5", 7)],
        "upload_id int, tenant_id string, file_hash string, submitted_at int")
    catalog = spark.createDataFrame(
        [("old", "t", "h2", "ready", True, 1, True), ("new", "t", "h2", "processing", True, 2, True),
         ("bad", "t", "h3", "failed", True, 1, True), ("gone", "t", "h4", "ready", False, 1, True),
         ("done", "t", "h5", "ready", True, 1, True)],
        "asset_id string, tenant_id string, file_hash string, upload_status string, "
        "is_active boolean, created_at int, file_exists boolean")
    got = {r["upload_id"]: (r["asset_id"], r["action"], r["status"])
           for r in register_assets(incoming, catalog).collect()}
    assert got == {
        1: ("1", "new", "queued"), 2: ("1", "reuse", "pending"), 3: ("3", "new", "queued"),
        4: ("new", "reuse", "processing"), 5: ("5", "new", "queued"), 6: ("6", "new", "queued"),
        7: ("done", "reuse", "already_exists")}
    again = {r["upload_id"]: (r["action"], r["status"])
             for r in register_assets(incoming, catalog, requeue=True).collect()}
    assert again[4] == ("requeue", "queued") and again[7] == ("reuse", "already_exists")
    assert again[2] == ("requeue", "queued")


def test_catalog_lifecycle(spark):
    incoming = spark.createDataFrame(
        [("1", "t", "h1", 1), ("2", "t", "h1", 2), ("3", "t", "h2", 3)],
        "upload_id string, tenant_id string, file_hash string, submitted_at int")
    catalog = spark.createDataFrame(
        [("old", "t", "h2", "processing", True, 1, True, None)],
        "asset_id string, tenant_id string, file_hash string, upload_status string, "
        "is_active boolean, created_at int, file_exists boolean, row_count bigint")
    decided = register_assets(incoming, catalog, requeue=True)
    after = apply_registration(catalog, incoming, decided)
    assert {r["asset_id"]: r["upload_status"] for r in after.collect()} == {
        "old": "pending", "1": "pending"}
    outcomes = spark.createDataFrame([("old", "failed", 7), ("1", "ready", 9)],
                                     "asset_id string, upload_status string, row_count bigint")
    done = {r["asset_id"]: (r["upload_status"], r["row_count"], r["is_active"])
            for r in record_outcomes(after, outcomes).collect()}
    assert done == {"old": ("failed", None, True), "1": ("ready", 9, True)}


def test_newest_per_key_without_other_columns(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, t int")
    assert {tuple(r) for r in newest_per_key(df, ["k"], ["t"]).collect()} == {("a", 3), ("b", 2)}


def test_publish_replaces(spark):
    name = published_table_name("aaaa-bbbbcccc", "dd-ddeeeeff-ff")
    assert name == "t_aaaabbbb_ddddeeee"
    for rows in ([("x",), ("x",)], [("y",)]):
        df = spark.createDataFrame(rows, "v string")
        assert publish_dataset(df, "aaaa-bbbbcccc", "dd-ddeeeeff-ff") == name
        assert spark.table(name).count() == len(rows)
    assert spark.table(name).columns == ["v", "_row_id"]
    withdraw_dataset(spark, "aaaa-bbbbcccc", "dd-ddeeeeff-ff")
    assert not spark.catalog.tableExists(name) and published_versions(spark, name) == []
    withdraw_dataset(spark, "aaaa-bbbbcccc", "dd-ddeeeeff-ff")


def test_failed_publish_leaves_the_old_version(spark):
    ids = ("tenant-a", "data-one")
    name = published_table_name(*ids)
    # a plain table of that name gives way to versions
    spark.range(3).write.saveAsTable(name)
    publish_dataset(spark.range(10).select("id"), *ids)
    reader = spark.table(name)
    with pytest.raises(PySparkException):
        publish_dataset(spark.range(10).select(
            F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id")), *ids)
    assert spark.table(name).count() == 10
    # from its own rows, while an older reader is still open
    publish_dataset(spark.table(name).select((F.col("id") + 100).alias("id")), *ids)
    assert reader.agg(F.max("id")).first()[0] == 9
    assert spark.table(name).agg(F.min("id"), F.count("id")).first() == (100, 10)
    publish_dataset(spark.range(2), *ids, keep=0)
    assert len(published_versions(spark, name)) == 1 and spark.table(name).count() == 2
    # versions of a name that goes on are another dataset's
    other = publish_dataset(spark.range(1), "tenant-a", "data-on_v")
    assert len(published_versions(spark, name)) == 1
    withdraw_dataset(spark, *ids)
    assert spark.table(other).count() == 1
    withdraw_dataset(spark, "tenant-a", "data-on_v")


def test_resolve_keeps_order_and_drops_unusable(spark):
    ids = ["0" * 31 + str(i) for i in range(5)]
    dashed = f"{ids[1][:8]}-{ids[1][8:12]}-{ids[1][12:16]}-{ids[1][16:20]}-{ids[1][20:]}"
    requests = spark.createDataFrame(
        [(1, "t", ["{%s}" % dashed.upper(), ids[0], "nope", ids[2], ids[3], ids[4]]),
         (2, "t", [])],
        "request_id int, tenant_id string, dataset_ids array<string>")
    catalog = spark.createDataFrame(
        [(ids[0], "t", "ready", "t0", True, 5), (ids[1], "t", "ready", "t1", True, 6),
         (ids[2], "other", "ready", "t2", True, 7), (ids[3], "t", "pending", "t3", True, 8),
         (ids[4], "t", "ready", None, True, 9)],
        "asset_id string, tenant_id string, upload_status string, table_name string, "
        "has_schema boolean, row_count bigint")
    got = {r["request_id"]: [d["table_name"] for d in r["datasets"]]
           for r in resolve_datasets(requests, catalog).collect()}
    assert got == {1: ["t1", "t0"], 2: []}
    assert spark.range(1).select(canonical_id(F.lit("urn:uuid:" + dashed)).alias("c")) \
        .first()["c"] == ids[1]


def test_column_tags_replace_the_map(spark):
    catalog = spark.createDataFrame([("a", {"x": "feature"}), ("b", {"x": "target"})],
                                    "asset_id string, column_tags map<string,string>")
    got = {r[0]: r[1] for r in set_column_tags(catalog, "a", {"y": "ignore"}).collect()}
    assert got == {"a": {"y": "ignore"}, "b": {"x": "target"}}


def test_tenancy(spark):
    key = spark.createDataFrame([("secret",)], "k string").select(tenant_id_of(F.col("k"))).first()
    assert key[0] == hashlib.sha256(b"secret").hexdigest()[:16]
    chunks = spark.createDataFrame(
        [(1, "t", "d1"), (2, "t", "d2"), (3, "t", "d3"), (4, "u", "d1")],
        "chunk_id int, tenant_id string, document_id string")

    def ids(df):
        return sorted(r["chunk_id"] for r in df.collect())

    assert ids(scope_to_tenant(chunks, "u")) == [4]
    assert ids(scope_chunks(chunks, "t")) == ids(scope_chunks(chunks, "t", [])) == [1, 2, 3]
    assert ids(scope_chunks(chunks, "t", ["d1"])) == [1]
    assert ids(scope_chunks(chunks, "t", ["d1", "d3"])) == [1, 3]
    long = spark.createDataFrame([("d2",), ("d3",)], "document_id string")
    assert ids(scope_chunks(chunks, "t", long)) == [2, 3]


def test_replace_chunks_and_stale_models(spark):
    schema = "document_id string, chunk_id int, embedding_model string"
    store = spark.createDataFrame([("a", 1, "m1"), ("a", 2, "m1"), ("b", 3, None)], schema)
    new = spark.createDataFrame([("a", 9, "m2")], schema)

    def ids(df):
        return sorted(r["chunk_id"] for r in df.collect())

    assert ids(replace_document_chunks(store, new)) == [3, 9]
    both = spark.createDataFrame([("a",), ("b",), ("b",)], "document_id string")
    assert ids(replace_document_chunks(store, new, both)) == [9]
    assert ids(replace_document_chunks(store, new.limit(0), both)) == []
    assert ids(stale_embeddings(store, "m1")) == [3]


def test_rows_with_surplus_cells_are_refused(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('a,b\n1,"x, y, ""z"", w"\n2\n3,q\n')
    rows = read_dataset(spark, str(good))
    assert rows.count() == 3 and sorted((r.a, r.b) for r in rows.collect()) == [(1, 'x, y, "z", w'), (2, None), (3, "q")]
    assert rows.select("b").filter("b = 'q'").count() == 1
    for name, row in (("one", "2,x,y"), ("empty", "2,x,"), ("late", "2,x,,y"), ("quoted", '2,"x, y",z')):
        bad = tmp_path / f"{name}.csv"
        bad.write_text(f"a,b\n1,w\n{row}\n")
        with pytest.raises(Exception, match="more than 2 cells"):
            read_dataset(spark, str(bad)).collect()
        with pytest.raises(Exception, match="more than 2 cells"):
            read_dataset(spark, str(bad), rows.schema).count()
