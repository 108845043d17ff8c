"""Page blocks to retrieval chunks.

A block is one page of prose or one table: document_id, tenant_id, page, kind (text or table),
table_index, rows (array of arrays of cells, tables only), text (prose only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from premia.functions.text import is_blank, render_rows, words
from premia.operators.ordering import total_before
from premia.settings import (
    CHUNK_OVERLAP_TOKENS, CHUNK_TOKENS, TABLE_GROUP_LINES, TABLE_WORD_LIMIT, TOKENS_PER_WORD,
)

# Pages of one document that share a numbering bucket.
_PAGES_PER_BUCKET = 256


def window_sizes(size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP_TOKENS) -> tuple[int, int]:
    """(words per chunk, words between chunk starts). Without overlap the chunks tile."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    width = int(size / TOKENS_PER_WORD)
    return width, width - int(overlap / TOKENS_PER_WORD)


def _prose_windows(word_list: Column, n_words: Column, width: int, step: int) -> Column:
    """Texts of the overlapping windows; the last one ends with the last word."""
    last_start = F.ceil(F.greatest(n_words - width, F.lit(0)) / step) * step
    starts = F.sequence(F.lit(1).cast("bigint"), last_start + 1, F.lit(step).cast("bigint"))
    return F.transform(
        starts, lambda start: F.array_join(F.slice(word_list, start.cast("int"), width), " "))


def chunk_text(blocks: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP_TOKENS,
               text: str = "text") -> DataFrame:
    """Prose chunks of each page, with ``position`` on the page. Narrow: no shuffle.

    Keeps the other columns; pages without words yield nothing.
    """
    width, step = window_sizes(size, overlap)
    others = [c for c in blocks.columns if c != text]
    split = blocks.select(*others, words(F.col(text)).alias("_words")) \
        .withColumn("_n", F.size("_words"))
    # a page without words has no windows; a filter on the count would split the text twice
    windows = F.when(F.col("_n") > 0,
                     _prose_windows(F.col("_words"), F.col("_n"), width, step))
    return split.select(*others, F.posexplode(windows).alias("position", text))


def _table_pieces(blocks: DataFrame) -> DataFrame:
    """Each table as ``_pieces``, whole or by 20 lines, and ``_long``; blank tables drop out."""
    others = [c for c in blocks.columns if c not in ("rows", "text")]
    rendered = blocks.select(*others, render_rows(F.col("rows")).alias("_table")) \
        .filter(~is_blank(F.col("_table"))) \
        .withColumn("_long", F.size(words(F.col("_table"))) > TABLE_WORD_LIMIT) \
        .withColumn("_lines", F.split("_table", "\n", -1))
    groups = F.transform(
        F.sequence(F.lit(1), F.size("_lines"), F.lit(TABLE_GROUP_LINES)),
        lambda start: F.array_join(F.slice("_lines", start, TABLE_GROUP_LINES), "\n"),
    )
    return rendered.select(
        *others, "_long",
        F.when(F.col("_long"), groups).otherwise(F.array("_table")).alias("_pieces"))


def chunk_tables(blocks: DataFrame) -> DataFrame:
    """Table chunks: a table of up to 1150 words whole, a longer one by 20 lines.

    Adds text, position and row_group (null for whole tables). Narrow.
    """
    pieces = _table_pieces(blocks)
    others = [c for c in pieces.columns if c != "_pieces"]
    return pieces.select(*others, F.posexplode("_pieces").alias("position", "text")) \
        .withColumn("row_group", F.when(F.col("_long"), F.col("position"))).drop("_long")


def chunk_id(document_id: Column, kind: Column, page: Column, item: Column, position: Column
             ) -> Column:
    """The same chunk of the same document always gets the same id."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in
             (document_id, kind, page, item, position)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _chunks_per_page(n_words: Column, size: int, overlap: int) -> Column:
    width, step = window_sizes(size, overlap)
    return F.when(n_words == 0, 0).otherwise(
        1 + F.ceil(F.greatest(n_words - width, F.lit(0)) / step))


def chunk_documents(blocks: DataFrame, size: int = CHUNK_TOKENS,
                    overlap: int = CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """All chunks of all documents: tables first, then prose by page, numbered per document.

    A block (document_id, kind, page, table_index) must be unique. With an ``ocr_text`` column,
    pages without a text layer take that text. Numbers are counted over one
    light row per block, in buckets of pages, so a document that holds much of the corpus is
    numbered by many tasks; the texts are only joined to their block's first number.
    """
    if "ocr_text" in blocks.columns:
        blocks = blocks.withColumn(
            "text", F.when(is_blank(F.col("text")), F.col("ocr_text")).otherwise(F.col("text")))
    prose = blocks.filter(F.col("kind") == "text").withColumn("table_index", F.lit(-1))
    tables = blocks.filter(F.col("kind") == "table")
    place = ["document_id", "page", "table_index"]
    kept = [*place, "tenant_id"]
    table_chunks = chunk_tables(tables.select(*kept, "rows")).withColumn("type", F.lit("table"))
    prose_chunks = chunk_text(prose.select(*kept, "text"), size, overlap) \
        .withColumn("type", F.lit("text")).withColumn("row_group", F.lit(None).cast("int"))
    counts = _table_pieces(tables.select(*place, "rows")).select(
        *place, F.lit("table").alias("type"), F.size("_pieces").cast("bigint").alias("_n"),
    ).unionByName(
        prose.select(*place, F.size(words(F.col("text"))).alias("_words")).select(
            *place, F.lit("text").alias("type"),
            _chunks_per_page(F.col("_words"), size, overlap).alias("_n")))
    is_prose = F.when(F.col("type") == "text", 1).otherwise(0)
    # a null page sorts first, so its bucket does too
    bucket = is_prose.cast("bigint") * (1 << 40) + F.coalesce(
        F.floor(F.col("page") / _PAGES_PER_BUCKET), F.lit(-1))
    first = total_before(counts, ["document_id"],
                         [is_prose, F.col("page"), F.col("table_index")], bucket,
                         F.col("_n"), "_first", light=True)
    # null-safe: a table without an index, or a block without a page, is a block like others
    found = first.select(*[F.col(c).alias(f"_{c}") for c in (*place, "type")], "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*place, "type")]
    numbered = table_chunks.unionByName(prose_chunks).join(found, same).drop(*[f"_{c}" for c in (*place, "type")])
    return numbered.select(
        chunk_id(F.col("document_id"), F.col("type"), F.col("page"), F.col("table_index"),
                 F.col("position")).alias("chunk_id"),
        "document_id", "tenant_id", "page", "type",
        (F.col("_first") + F.col("position")).alias("chunk_index"), "table_index", "row_group",
        "text",
    )


def flag_empty_pages(blocks: DataFrame) -> DataFrame:
    """Prose pages with needs_ocr: true where there is no text layer."""
    return blocks.filter(F.col("kind") == "text") \
        .withColumn("needs_ocr", is_blank(F.col("text")))


def document_stats(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_count, page_count and ocr_used per document; documents without chunks count 0.

    ``blocks`` may carry ``ocr_text``, the text found on pages without a text layer.
    """
    read_by_ocr = (is_blank(F.col("text")) & ~is_blank(F.col("ocr_text"))
                   if "ocr_text" in blocks.columns else F.lit(False))
    pages = blocks.groupBy("document_id").agg(
        F.max("page").alias("page_count"),
        F.bool_or((F.col("kind") == "text") & read_by_ocr).alias("ocr_used"))
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return pages.join(counts, "document_id", "left").select(
        "document_id", F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"),
        "page_count", "ocr_used")
