"""Queries over documents: chunks, chunk store, embeddings, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from premia.functions.models import embedder, pair_scorer, text_model
from premia.functions.tenancy import scope_chunks
from premia.operators.chunking import (
    chunk_documents, chunk_tables, chunk_text, document_stats, flag_empty_pages,
)
from premia.operators.embedding import count_terms, embed_chunks, fit_tfidf
from premia.operators.retrieval import build_cells, vector_top_k, vector_top_k_approx
from premia.plans.decision import find_evidence
from premia.plans.registry import query
from premia.plans.tables import (
    CHUNKS_SQL, PROSE_CHUNKS_SQL, TABLE_CHUNKS_SQL, all_blocks, prose_blocks, table, table_blocks,
)
from premia.sources.chunk_store import replace_document_chunks, stale_embeddings
from premia.session import materialize

_TERMS = "[x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']"


@query("prose_chunks", f"SELECT document_id, page, position, text FROM ({PROSE_CHUNKS_SQL}) c")
def _prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_text(prose_blocks(spark, sf_dir)).select("document_id", "page", "position", "text")


@query("table_chunks", f"""
    SELECT document_id, page, table_index, row_group, position, text FROM ({TABLE_CHUNKS_SQL}) c
""")
def _table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_tables(table_blocks(spark, sf_dir)).select(
        "document_id", "page", "table_index", "row_group", "position", "text")


@query("chunk_documents", CHUNKS_SQL)
def _chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(all_blocks(spark, sf_dir))


@query("flag_empty_pages", """
    SELECT source || '-' || lang AS document_id, doc_id AS page,
           NOT regexp_matches(text, '[0-9]') AS needs_ocr
    FROM documents
""")
def _flag_empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the corpus has no empty page, so only a page's digits count as its text layer here
    digits = prose_blocks(spark, sf_dir).withColumn(
        "text", F.regexp_replace("text", "[^0-9]", " "))
    return flag_empty_pages(digits).select("document_id", "page", "needs_ocr")


@query("document_stats", f"""
    SELECT b.document_id, coalesce(c.n, 0) AS chunk_count, b.page_count, false AS ocr_used
    FROM (SELECT source || '-' || lang AS document_id, max(doc_id) AS page_count
          FROM documents GROUP BY ALL
          UNION ALL SELECT 'customers', max(c_custkey // 400) FROM customer
          UNION ALL SELECT 'nations', 1) b
    LEFT JOIN (SELECT document_id, count(*) AS n FROM ({CHUNKS_SQL}) k GROUP BY ALL) c
        USING (document_id)
""")
def _document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = all_blocks(spark, sf_dir)
    return document_stats(blocks, chunk_documents(blocks))


_REVISED_SQL = f"""
    SELECT document_id, tenant_id, page, type, table_index, row_group, position, text
    FROM ({PROSE_CHUNKS_SQL}) p WHERE position > 0 AND document_id LIKE 'src1-%'
        AND document_id NOT LIKE '%-es'
"""


@query("replace_chunks", f"""
    SELECT document_id, page, position, text FROM ({PROSE_CHUNKS_SQL}) p
    WHERE document_id NOT LIKE 'src1-%' AND document_id NOT LIKE '%-es'
    UNION ALL SELECT document_id, page, position, text FROM ({_REVISED_SQL}) r
""")
def _replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src1 comes again without first chunks; all Spanish documents come again empty."""
    store = chunk_text(prose_blocks(spark, sf_dir)).select(
        "document_id", "page", "position", "text")
    new = store.filter(F.col("document_id").startswith("src1-") & (F.col("position") > 0)
                       & ~F.col("document_id").endswith("-es"))
    again = prose_blocks(spark, sf_dir).select("document_id").filter(
        F.col("document_id").startswith("src1-") | F.col("document_id").endswith("-es"))
    return replace_document_chunks(store, new, again)


# --- vectors -----------------------------------------------------------------

def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("tenant_id"), "embedding",
        (F.col("vec_id") % 7).alias("document_id"))


def _top_k_sql(scope: str) -> str:
    return f"""
    SELECT q.vec_id AS question_id, v.vec_id AS chunk_id,
           round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 4) + 0.0
               AS similarity_score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(
               q.embedding::double[], v.embedding::double[]), 12) DESC, v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON q.label = v.label {scope}
    QUALIFY rank <= 20
    """


@query("scope_chunks", """
    SELECT vec_id AS chunk_id, vec_id % 7 AS document_id FROM embeddings
    WHERE label = 3 AND vec_id % 7 IN (1, 4)
""")
def _scope_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_chunks(_vectors(spark, sf_dir), 3, [1, 4]).select("chunk_id", "document_id")


@query("vector_top_k", _top_k_sql(""))
def _vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return vector_top_k(vectors.withColumnRenamed("chunk_id", "question_id"), vectors)


@query("vector_top_k_documents", _top_k_sql(
    "AND (q.vec_id % 3 = 0 OR v.vec_id % 7 IN (q.vec_id % 7, (q.vec_id + q.vec_id % 3) % 7))"))
def _vector_top_k_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the questions has no document filter, the others name one or two documents."""
    vectors = _vectors(spark, sf_dir)
    own = F.col("document_id")
    shift = F.col("chunk_id") % 3
    questions = vectors.select(
        F.col("chunk_id").alias("question_id"), "tenant_id", "embedding",
        F.when(shift == 0, F.array().cast("array<bigint>"))
        .otherwise(F.array(own, (own + shift) % 7)).alias("document_ids"))
    return vector_top_k(questions, vectors)


@query("vector_top_k_approx")
def _vector_top_k_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    index = build_cells(vectors, cells=16)
    return vector_top_k_approx(
        vectors.withColumnRenamed("chunk_id", "question_id"), vectors, index, probes=4)


# --- the text pipeline: chunk, embed, search, re-score -------------------------

def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(all_blocks(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), tenant_of(F.col("item_id")).alias("tenant_id"),
        F.col("text").alias("question"))


def tenant_of(item_id: Column) -> Column:
    """Questions go round the tenants, which are the four languages."""
    return F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (item_id % 4 + 1).cast("int"))


def top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of its tenant for each benchmark text."""
    # the chunk store is a table in real use: written once, then read by every step
    chunks = materialize(count_terms(text_chunks(spark, sf_dir)), "chunks")
    return find_evidence(questions(spark, sf_dir), chunks, fit_tfidf(chunks))


_ASKED_SQL = "SELECT item_id AS question_id, text FROM benchmark"


def _tfidf_ctes(chunks_sql: str, asked_sql: str = _ASKED_SQL) -> str:
    """CTEs chunk, asked, weight (text side) and qweight: unit TF-IDF weights per slot."""
    slot = "('0x' || substr(md5(t), 1, 8))::bigint % 256"
    return f"""
    chunk AS MATERIALIZED ({chunks_sql}),
    asked AS ({asked_sql}),
    tf AS MATERIALIZED (SELECT chunk_id, {slot} AS slot, count(*) AS n
           FROM (SELECT chunk_id, unnest({_TERMS}) AS t FROM chunk) GROUP BY ALL),
    idf AS (SELECT slot, ln(((SELECT count(*) FROM chunk) + 1.0) / (count(*) + 1.0)) AS w
            FROM tf GROUP BY slot),
    weight AS MATERIALIZED (SELECT chunk_id, slot, (n * w / sqrt(sum(n * w * n * w)
                   OVER (PARTITION BY chunk_id)))::float::double AS x FROM tf JOIN idf USING (slot)),
    qtf AS (SELECT question_id, {slot} AS slot, count(*) AS n
            FROM (SELECT question_id, unnest({_TERMS}) AS t FROM asked) GROUP BY ALL),
    qweight AS MATERIALIZED (SELECT question_id, slot, (n * w / sqrt(sum(n * w * n * w)
                    OVER (PARTITION BY question_id)))::float::double AS x
                FROM qtf JOIN idf USING (slot))
    """


def evidence_ctes(asked_sql: str = _ASKED_SQL) -> str:
    """CTEs up to ``evidence``: the five best chunks of each asked text."""
    return f"""
    {_tfidf_ctes(CHUNKS_SQL, asked_sql)},
    scored AS (
        SELECT question_id, chunk_id, sum(q.x * v.x) / sqrt(any_value(qn) * any_value(vn)) AS score
        FROM (SELECT *, sum(x * x) OVER (PARTITION BY question_id) AS qn,
                     (['en', 'de', 'fr', 'es'])[question_id % 4 + 1] AS tenant_id FROM qweight) q
        JOIN (SELECT w.*, k.tenant_id, sum(x * x) OVER (PARTITION BY chunk_id) AS vn
              FROM weight w JOIN chunk k USING (chunk_id)) v USING (slot, tenant_id)
        GROUP BY ALL),
    cosine AS (
        SELECT question_id, k.chunk_id, round(coalesce(s.score, 0), 12) + 0.0 AS score,
               round(round(coalesce(s.score, 0), 12), 4) + 0.0 AS similarity_score
        FROM asked a JOIN chunk k ON k.tenant_id = (['en', 'de', 'fr', 'es'])[a.question_id % 4 + 1]
        LEFT JOIN scored s USING (question_id, chunk_id)),
    candidate AS MATERIALIZED (
        SELECT * FROM cosine QUALIFY row_number() OVER (
            PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 20),
    overlap AS (
        SELECT c.*, k.document_id, k.page, k.text, a.text AS question,
               len(list_intersect({_TERMS.replace('text', 'a.text')},
                                  {_TERMS.replace('text', 'k.text')}))::double AS rerank_score
        FROM candidate c JOIN chunk k USING (chunk_id) JOIN asked a USING (question_id)),
    evidence AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC,
                                     similarity_score DESC, chunk_id) AS rank
        FROM overlap QUALIFY rank <= 5)
    """


EVIDENCE_SQL_CTES = evidence_ctes()


@query("rerank_lexical", f"""
    WITH {EVIDENCE_SQL_CTES}
    SELECT question_id, rank, chunk_id, similarity_score, rerank_score FROM evidence
""")
def _rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_evidence(spark, sf_dir).select(
        "question_id", "rank", "chunk_id", "similarity_score", "rerank_score")


@query("embed_tfidf", f"""
    WITH {_tfidf_ctes(CHUNKS_SQL)}
    SELECT chunk_id, 'hashed-tfidf-256' AS embedding_model, slot, round(x, 5) AS x
    FROM weight WHERE x <> 0
""")
def _embed_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = text_chunks(spark, sf_dir).select("chunk_id", "text")
    chunks = materialize(count_terms(texts).drop("text"), "chunks")
    embedded = embed_chunks(chunks, fit_tfidf(chunks))
    # the outer form, since Spark tests the array of the other one and makes it twice
    return embedded.select(
        "chunk_id", "embedding_model", F.posexplode_outer("embedding").alias("slot", "x")
    ).filter("x <> 0").withColumn("slot", F.col("slot").cast("bigint")).withColumn(
        "x", F.round(F.col("x").cast("double"), 5))


@query("stale_embeddings", f"""
    SELECT document_id, page, position,
           CASE WHEN document_id LIKE '%-en' THEN 'model-b'
                WHEN document_id NOT LIKE '%-de' THEN 'model-a' END AS embedding_model
    FROM ({PROSE_CHUNKS_SQL}) c WHERE document_id NOT LIKE '%-en'
""")
def _stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = chunk_text(prose_blocks(spark, sf_dir)).select(
        "document_id", "page", "position",
        F.when(F.col("document_id").endswith("-en"), "model-b")
        .when(~F.col("document_id").endswith("-de"), "model-a").alias("embedding_model"))
    return stale_embeddings(store, "model-b")


# --- hooks for outside models, with plain functions of the text as models -----------

_LANGUAGE_LETTERS = {"en": "w", "de": "z", "fr": "u", "es": "o"}


def _letter_counts():
    """Stands in for an embedding model: how often each language's letter occurs."""
    return lambda texts: [[float(t.count(c)) for c in _LANGUAGE_LETTERS.values()] for t in texts]


def _first_and_last_word():
    """Stands in for a text model."""
    return lambda texts: [" … ".join((t.split(" ")[0], t.split(" ")[-1])) for t in texts]


def _times_asked():
    """Stands in for a pair model: how often the text holds the question."""
    return lambda pairs: [float(text.count(question)) for question, text in pairs]


def _occurrences(letter: str) -> str:
    return f"(len(text) - len(replace(text, {letter}, '')))::double"


@query("model_embedder", "SELECT doc_id, " + ", ".join(
    f"{_occurrences(repr(letter))} AS x{i}" for i, letter in enumerate(_LANGUAGE_LETTERS.values())) + """
    , CASE WHEN text IS NOT NULL THEN 4 END AS width FROM documents
""")
def _model_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").withColumn("v", embedder(_letter_counts)(F.col("text")))
    return made.select(
        "doc_id", *[F.get("v", F.lit(i)).cast("double").alias(f"x{i}") for i in range(len(_LANGUAGE_LETTERS))],
        F.size("v").alias("width"))


@query("model_text", """
    SELECT doc_id, split_part(text, ' ', 1) || ' … ' || split_part(text, ' ', -1) AS reply FROM documents
""")
def _model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", text_model(_first_and_last_word)(F.col("text")).alias("reply"))


@query("model_pair_scorer", f"""
    SELECT doc_id, lang, {_occurrences("substr(lang, 1, 1)")} AS score FROM documents
""")
def _model_pair_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", pair_scorer(_times_asked)(F.substring("lang", 1, 1), F.col("text")).alias("score"))
