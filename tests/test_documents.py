import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.functions.models import embedder, pair_scorer
from premia.operators.chunking import (
    chunk_documents, chunk_tables, chunk_text, document_stats, flag_empty_pages, window_sizes,
)
from premia.operators.embedding import count_terms, embed_chunks, fit_tfidf
from premia.operators.ordering import last_before, number_along
from premia.operators.retrieval import (
    build_cells, lexical_overlap, rerank, vector_top_k, vector_top_k_approx,
)
from premia.session import spread


def n_chunks(n):
    return 0 if n == 0 else 1 if n <= 393 else 1 + -(-(n - 393) // 355)


def test_prose_windows(spark):
    sizes = [0, 1, 392, 393, 394, 600, 748, 749, 800, 5000]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes],
                               "n int, text string")
    got = {}
    for r in chunk_text(df).collect():
        got.setdefault(r["n"], {})[r["position"]] = r["text"].split(" ")
    for n in sizes:
        chunks = got.get(n, {})
        assert len(chunks) == n_chunks(n)
        for position, words in chunks.items():
            start = 355 * position
            assert words == [f"w{i}" for i in range(start, min(start + 393, n))]
    assert [len(got[800][i]) for i in range(3)] == [393, 393, 90]


def test_window_settings():
    assert window_sizes() == (393, 355) and window_sizes(512, 0) == (393, 393)
    with pytest.raises(ValueError):
        window_sizes(50, 50)


def test_unicode_blanks_split_words(spark):
    text = "a b　c\x1cd\x0be f \t g"
    df = spark.createDataFrame([(text,), ("   \n",)], "text string")
    assert [r["text"] for r in chunk_text(df).collect()] == [" ".join(text.split())]


BLOCK = ("document_id string, tenant_id string, page int, kind string, table_index int, "
         "rows array<array<string>>, text string")


def test_tables(spark):
    big = [[f"cell {i}", None, " x "] for i in range(400)]
    df = spark.createDataFrame([
        ("d", "t", 1, "table", 0, [["a ", None], [" b", "c"]], None),
        ("d", "t", 2, "table", 0, big, None),
        ("d", "t", 3, "table", 0, [[" "], [None]], None),
        ("d", "t", 4, "table", 0, [["", None]], None)], BLOCK)
    chunks = {(r["page"], r["position"]): r for r in chunk_tables(df).collect()}
    assert chunks[1, 0]["text"] == "a | \nb | c" and chunks[1, 0]["row_group"] is None
    assert sum(1 for page, _ in chunks if page == 2) == 20
    lines = "\n".join(chunks[2, i]["text"] for i in range(20)).split("\n")
    assert len(lines) == 400 and lines[399] == "cell 399 |  | x"
    assert chunks[2, 19]["row_group"] == 19
    # a bar between empty cells is text, single empty cells are not
    assert not any(page == 3 for page, _ in chunks) and chunks[4, 0]["text"] == " | "


def test_document_numbers_across_buckets(spark):
    blocks = spark.createDataFrame(
        [("hot", "t", p, "text", None, None, "w " * (400 if p % 100 == 0 else 3))
         for p in range(1, 1001)]
        + [("hot", "t", 900, "table", 1, [["x"]], None), ("hot", "t", 5, "table", 0, [["y"]], None),
           ("small", "t", 1, "text", None, None, "only one"),
           ("small", "t", 2, "text", None, None, "  ")], BLOCK)
    chunks = chunk_documents(blocks).collect()
    hot = sorted((r for r in chunks if r["document_id"] == "hot"), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in hot] == list(range(2 + 1000 + 10))
    assert [(r["type"], r["page"]) for r in hot[:2]] == [("table", 5), ("table", 900)]
    pages = [r["page"] for r in hot[2:]]
    assert pages == sorted(pages)
    assert len({r["chunk_id"] for r in chunks}) == len(chunks)
    again = {r["chunk_id"] for r in chunk_documents(blocks.repartition(3)).collect()}
    assert again == {r["chunk_id"] for r in chunks}
    stats = {r["document_id"]: r for r in document_stats(blocks, chunk_documents(blocks)).collect()}
    assert (stats["hot"]["chunk_count"], stats["hot"]["page_count"]) == (1012, 1000)
    assert (stats["small"]["chunk_count"], stats["small"]["ocr_used"]) == (1, False)
    empty = [r["page"] for r in flag_empty_pages(blocks).filter("needs_ocr").collect()]
    assert empty == [2]


def test_ocr_text_fills_empty_pages(spark):
    blocks = spark.createDataFrame([("d", "t", 1, "text", None, None, " ", "read by ocr"),
                                    ("d", "t", 2, "text", None, None, "kept", "ignored")],
                                   BLOCK + ", ocr_text string")
    chunks = chunk_documents(blocks)
    assert [r["text"] for r in chunks.orderBy("page").collect()] == ["read by ocr", "kept"]
    stats = document_stats(blocks, chunks).first()
    assert stats["ocr_used"] and stats["chunk_count"] == 2


def test_numbers_along_a_hot_key_equal_a_window(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, (i * 7919) % 1000) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, id int, t int").repartition(5)
    got = {r["id"]: (r["n"], r["prev"]) for r in last_before(
        number_along(df, ["k"], ["t", "id"], F.floor(F.col("t") / 10), "n"),
        ["k"], ["t", "id"], F.floor(F.col("t") / 10),
        F.when(F.col("id") % 5 == 0, F.col("id")), "prev").collect()}
    seen = {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        n, last = seen.get(k, (0, None))
        assert got[i] == (n, last)
        seen[k] = (n + 1, i if i % 5 == 0 else last)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    data = rng.normal(size=(400, 16)).astype("float32")
    data[100:230] = data[100]  # a third are copies
    data[399] = 0
    tenants = ["hot" if i % 4 else "cold" for i in range(400)]
    df = spark.createDataFrame(
        [(i, tenants[i], i % 5, [float(x) for x in data[i]]) for i in range(400)],
        "chunk_id bigint, tenant_id string, document_id int, embedding array<float>")
    return df, data.astype("float64"), tenants


def brute(data, tenants, q, tenant, k, documents=()):
    def unit(v):
        return v / (np.linalg.norm(v) or 1.0)
    scored = [(-(round(float(unit(q) @ unit(data[i])), 12) + 0.0), i) for i in range(len(data))
              if tenants[i] == tenant and (not documents or i % 5 in documents)]
    return [(i, round(-s, 4)) for s, i in sorted(scored)[:k]]


@pytest.mark.parametrize("blocks", [(32768, 4096), (37, 9)])
def test_exact_top_k_equals_brute_force(spark, vectors, blocks):
    df, data, tenants = vectors
    asked = [(q, "hot" if q % 2 else "cold", [[], [1], [0, 3], None][q % 4]) for q in range(60)]
    questions = spark.createDataFrame(
        [(q, t, docs, [float(x) for x in data[q * 3]]) for q, t, docs in asked],
        "question_id int, tenant_id string, document_ids array<int>, embedding array<float>")
    got = {}
    for r in vector_top_k(questions, df, 7, *blocks).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], r["similarity_score"]))
    for q, tenant, docs in asked:
        want = brute(data, tenants, data[q * 3], tenant, 7, docs or ())
        assert [i for i, _ in got[q]] == [i for i, _ in want], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want])


def test_top_k_never_gathers_a_tenant(spark, vectors):
    df, _, _ = vectors
    odd = df.withColumn("tenant_id", F.when(F.col("chunk_id") >= 10, F.col("tenant_id")))
    questions = odd.filter("chunk_id < 60").withColumnRenamed("chunk_id", "question_id").drop("document_id")
    found = vector_top_k(questions, odd, 7, 37, 9)
    # null tenants meet nobody; all others get their answers
    assert found.count() == 50 * 7
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = vector_top_k(questions, odd, 7, 37, 9)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = [line for line in plan.split("\n") if "SortMergeJoin" in line]
    # only counts of scopes are joined by scope, vectors and questions never are
    assert joins and all("FullOuter" in line for line in joins)


def test_top_k_without_candidates(spark, vectors):
    df, _, _ = vectors
    questions = spark.createDataFrame([(1, "nobody", [0.5] * 16)],
                                      "question_id int, tenant_id string, embedding array<float>")
    assert vector_top_k(questions, df).count() == 0


def test_close_scores_rank_in_full(spark):
    df = spark.createDataFrame([(1, "t", [1.0, 0.009]), (2, "t", [1.0, 0.0]), (3, "t", None)],
                               "chunk_id int, tenant_id string, embedding array<double>")
    asked = df.filter("chunk_id = 2").withColumnRenamed("chunk_id", "question_id")
    assert [(r["chunk_id"], r["similarity_score"]) for r in vector_top_k(asked, df, 1).collect()] == [(2, 1.0)]


def test_approximate_search_is_filled_up(spark, vectors):
    df, _, _ = vectors
    questions = df.filter("chunk_id < 60").withColumnRenamed("chunk_id", "question_id").drop("document_id")
    index = build_cells(df, cells=8, seed=5)

    def counts(hits):
        return {r["question_id"]: r["count"] for r in hits.groupBy("question_id").count().collect()}

    assert counts(vector_top_k_approx(questions, df, index, probes=1, k=100)) == counts(
        vector_top_k(questions, df, 100))


def test_approximate_search(spark, vectors):
    df, _, _ = vectors
    questions = df.filter("chunk_id < 399").withColumnRenamed("chunk_id", "question_id") \
        .drop("document_id")
    index = build_cells(df, cells=8, seed=5)
    exact = {(r["question_id"], r["chunk_id"]) for r in vector_top_k(questions, df, 5).collect()}
    every = {(r["question_id"], r["chunk_id"])
             for r in vector_top_k_approx(questions, df, index, probes=8, k=5,
                                          vectors_per_block=50).collect()}
    assert every == exact
    some = {(r["question_id"], r["chunk_id"])
            for r in vector_top_k_approx(questions, df, index, probes=4, k=5).collect()}
    assert len(some & exact) / len(exact) > 0.75


def test_stored_counts_take_the_place_of_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "Young drivers, young cars"), (2, "old cars"), (3, ""), (4, "Jung und alt 42")],
                               "chunk_id int, text string")
    path = str(tmp_path / "counted")
    count_terms(df).drop("text").write.parquet(path)
    counted = spark.read.parquet(path)

    def vectors_of(table):
        made = embed_chunks(table, fit_tfidf(table)).select("chunk_id", "embedding", "embedding_model")
        return sorted(made.collect())

    assert vectors_of(counted) == vectors_of(df)
    assert "text" not in counted.columns and "slot_counts" not in embed_chunks(counted, fit_tfidf(counted)).columns


CANDIDATES = ("question_id int, question string, chunk_id string, text string, "
              "similarity_score double")


def test_rerank(spark):
    df = spark.createDataFrame([
        (1, "young drivers North", "a", "drivers drivers", 0.9),
        (1, "young drivers North", "b", "Young NORTH drivers!", 0.1),
        (1, "young drivers North", "c", "north", 0.95),
        (2, "alone", "d", "nothing", 0.2)], CANDIDATES)
    got = [(r["question_id"], r["rank"], r["chunk_id"], r["rerank_score"])
           for r in rerank(df, k=2).orderBy("question_id", "rank").collect()]
    assert got == [(1, 1, "b", 3.0), (1, 2, "c", 1.0), (2, 1, "d", None)]


def test_model_hooks(spark):
    def load_scorer():
        return lambda pairs: [float(len(t) - len(q)) for q, t in pairs]

    def load_embedder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "q", "a", "x" * i, i / 10) for i in range(1, 8)], CANDIDATES)
    top = rerank(df.withColumn("chunk_id", F.col("text")), pair_scorer(load_scorer, 3), 3)
    assert [r["rerank_score"] for r in top.orderBy("rank").collect()] == [6.0, 5.0, 4.0]
    made = embed_chunks(df, embedder(load_embedder), "lengths-1")
    assert [tuple(r) for r in made.select("embedding", "embedding_model").orderBy("text").collect()
            ][:2] == [([1.0, 1.0], "lengths-1"), ([2.0, 1.0], "lengths-1")]
    with pytest.raises(ValueError):
        embed_chunks(df, embedder(load_embedder))


def test_tfidf_vectors(spark):
    df = spark.createDataFrame([("a", "Motor motor rates"), ("b", "home rates"), ("c", "...")],
                               "chunk_id string, text string")
    model = fit_tfidf(df, dimensions=64)
    rows = {r["chunk_id"]: np.array(r["embedding"]) for r in embed_chunks(df, model).collect()}
    assert np.isclose(np.linalg.norm(rows["a"]), 1) and not rows["c"].any()
    assert 0 < rows["a"] @ rows["b"] < 1
    assert embed_chunks(df, model).first()["embedding_model"] == "hashed-tfidf-64"


def test_slots_follow_from_md5(spark):
    import hashlib

    from premia.operators.embedding import _slot_names, _slots
    df = spark.createDataFrame([("north motor été 42",)], "t string")
    for dimensions in (16, 256, 4096, 100):
        names = _slot_names(dimensions)
        got = [names.index(s) for s in df.select(_slots(F.col("t"), dimensions)).first()[0]]
        assert got == [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions
                       for w in ("north", "motor", "été", "42")]


def test_overlap_counts_distinct_terms(spark):
    row = spark.createDataFrame([("a a b", "B, c: a")], "q string, t string").select(
        lexical_overlap(F.col("q"), F.col("t"))).first()
    assert row[0] == 2.0


def test_a_table_without_an_index_keeps_its_chunks(spark):
    blocks = spark.createDataFrame(
        [("d", "t", "table", 1, None, None, [["a", "b"]]), ("d", "t", "table", 2, 0, None, [["c"]]),
         ("d", "t", "text", 1, None, "some words", None), ("d", "t", "text", None, None, "no page", None)],
        "document_id string, tenant_id string, kind string, page int, table_index int, text string, rows array<array<string>>")
    got = chunk_documents(blocks).collect()
    assert sorted((r["type"], r["text"]) for r in got) == [
        ("table", "a | b"), ("table", "c"), ("text", "no page"), ("text", "some words")]
    assert sorted(r["chunk_index"] for r in got) == [0, 1, 2, 3]


def test_vectors_of_other_widths_and_models_do_not_meet(spark):
    rows = [(1, "t", [1.0, 0.0], "m"), (2, "t", [0.0, 1.0], "m"), (3, "t", [1.0, 0.0, 0.0], "m"), (4, "t", [1.0, 0.0], "other"), (5, "t", None, "m")]
    df = spark.createDataFrame(rows, "chunk_id int, tenant_id string, embedding array<double>, embedding_model string")
    asked = df.withColumnRenamed("chunk_id", "question_id")
    got = vector_top_k(asked, df).collect()
    assert {(r["question_id"], r["chunk_id"]) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4)}
    got = vector_top_k(asked.drop("embedding_model"), df).collect()
    assert {(r["question_id"], r["chunk_id"]) for r in got if r["question_id"] == 1} == {(1, 1), (1, 2), (1, 4)}


def test_spread_grows_with_the_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    few = spread(spark.range(0, 1000, 1, 1), "id")
    more = spread(spark.range(0, 1000, 1, cores + 2), "id")
    assert few.rdd.getNumPartitions() == cores
    assert more.rdd.getNumPartitions() == 2 * (cores + 2)
    assert few.count() == more.count() == 1000
