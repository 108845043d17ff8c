"""The corpus operators as registered queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from premia.llm import (exact_dedup, filter_audit, jaccard_join, language, max_score, mixing, packing, pseudonyms, quality,
                        repeats, sharding, url_rules, vector_codes)
from premia.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir) and its SQL."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(tune(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Place of the public tokenizer that the packing contract names."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_exact_dedup", r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
    FROM d""")
def exact_dedup_query(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_id")


@query("op2_language_id")
def language_query(spark, sf_dir):
    return language.language_id(table(spark, sf_dir, "documents"))


@query("op3_pack_sequences")
def packing_query(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer()).drop("ids")


@query("op4_url_rules")
def url_query(spark, sf_dir):
    return url_rules.filter_urls(table(spark, sf_dir, "pages")).drop("why")


@query("op5_max_score", """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, v.vec_id,
             CAST(list_sum(list_transform(generate_series(1, len(v.x)), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.x) = len(v.x)),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= 5""")
def top_k_query(spark, sf_dir):
    vectors = max_score.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return max_score.top_k(vectors.filter(F.col("id") % 50 == 0), vectors, 5)


@query("op6_remove_repeats")
def repeats_query(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_mix_sources")
def mixing_query(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row_id")


@query("op8_shard_documents")
def sharding_query(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op9_pseudonyms")
def pseudonyms_query(spark, sf_dir):
    # A key for these tables; a real corpus keeps its own secret.
    return pseudonyms.replace_personal_data(table(spark, sf_dir, "documents"), key=b"key of the registered query")


@query("op10_jaccard_join")
def jaccard_query(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("row_id", "root")


@query("op11_filter_audit", r"""
    WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
               FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
    d AS (SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic, [
            len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
            100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
          FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, fails),
    f AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
    o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f AS a JOIN f AS b ON b.f <> a.f JOIN f AS c ON c.f NOT IN (a.f, b.f)
          JOIN f AS d ON d.f NOT IN (a.f, b.f, c.f) JOIN f AS e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
    s AS (SELECT o, f.f AS step, o[f.f] AS mine FROM o, f),
    x AS (SELECT m.part, s.o, s.step, s.mine, n, good, toxic, fails[mine] AS failing,
                 len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda b: b)) = 1 AS alone
          FROM m, s),
    r AS (SELECT part, o, step, mine, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS kept,
                 coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant,
                 coalesce(sum(n) FILTER (failing AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost,
                 coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost
          FROM x GROUP BY part, o, step, mine)
    SELECT part, list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, CAST(step AS INTEGER) AS step,
           CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
    FROM r""")
def filter_audit_query(spark, sf_dir):
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _codes_sql(rounds: int) -> str:
    """SQL of the vector codes: every pair of part and entry is compared."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
      SELECT vec_id, part, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
        SELECT p.vec_id, p.part, e.k, CAST(list_sum(list_transform(generate_series(1, len(p.x)), lambda i: (p.x[i] - e.x[i]) * (p.x[i] - e.x[i]))) AS BIGINT) AS d
        FROM p JOIN e{i} AS e ON p.part = e.part) GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""
    s{i} AS (SELECT a.part, a.k, pos, CAST(floor(CAST(sum(p.x[pos]) AS DOUBLE) / count(*)) AS BIGINT) AS c
             FROM (SELECT *, unnest(generate_series(1, len(x))) AS pos FROM p) AS p JOIN a{i} AS a USING (vec_id, part) GROUP BY a.part, a.k, pos),
    e{i + 1} AS MATERIALIZED (SELECT e.part, e.k, coalesce(n.x, e.x) AS x FROM e{i} AS e
             LEFT JOIN (SELECT part, k, list(c ORDER BY pos) AS x FROM s{i} GROUP BY part, k) AS n ON e.part = n.part AND e.k = n.k)""")
    return f"""
    WITH v AS (
      SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
    p AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // 16 + 1:(part + 1) * len(x) // 16] AS x
          FROM (SELECT vec_id, x, unnest(generate_series(0, 15)) AS part FROM v)),
    e0 AS MATERIALIZED (SELECT part, k, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k FROM p) WHERE k < 64),
    {",".join(steps).strip()},
    c AS (SELECT vec_id, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
    SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, k, pos))
            FROM (SELECT part, k, unnest(x) AS x, unnest(generate_series(1, len(x))) AS pos FROM e{rounds})) AS codebooks_sha256
    FROM v JOIN c USING (vec_id)"""


@query("op12_vector_codes", _codes_sql(vector_codes.ROUNDS))
def vector_codes_query(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_quality_votes")
def quality_query(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
