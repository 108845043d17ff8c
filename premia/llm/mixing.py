"""Mix sources to target weights: Sainte-Laguë quotas of words and of equal blocks of words, then seeded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from premia.llm.common import BLANK, beside, fresh, numbered, stored, text_of

# Weights of the sources in the order of their names, repeating; the largest repetition.
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 256
SHARD_ROWS = 1024
SEED = 20240229


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (no_source, source, source_size) with ``target``: words the mix should take of each.

    Weights follow the names in code point order, null last. Shares of all words go by weight; a share above
    ``most`` times its source stops there and its excess is shared out again. In the order of
    most * size / weight the full sources come first, so one running sum finds where they end.
    """
    named = Window.orderBy("no_source", F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    whole = Window.partitionBy()
    by_fill = whole.orderBy(F.col("limit") / F.col("weight"), "no_source", F.col("source").cast("binary"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    return (weighed
            .withColumn("free", F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            .withColumn("heavy", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("level", F.col("free") / F.col("heavy"))
            .withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
            .withColumn("end", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
            .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("end") * F.col("weight")))
            .select("no_source", "source", "source_size", "target"))


def sainte_lague(parties: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``parties`` (…, votes, seats) with ``quota``: the group's ``seats`` by highest quotients votes / (2i - 1).

    A party has floor(votes / 2q + 1/2) quotients of at least q. Of n parties with V votes, q = V / 2(seats - n/2) hands
    out at most all seats, q = V / 2(seats + n/2) at least all; only the quotients between, at
    most 2n of a group, are ranked. Ties go by ``order``, the columns that name a party and are never null. Without votes nobody gets a seat.
    """
    whole = Window.partitionBy(*group)
    counted = (parties.withColumn("all_votes", F.sum("votes").over(whole))
               .withColumn("n", F.sum(F.lit(1)).over(whole)))

    def reach(seats: Column) -> Column:
        return F.when((F.col("all_votes") > 0) & (seats > 0),
                      F.floor(F.col("votes") * seats / F.col("all_votes") + 0.5)).otherwise(F.lit(0)).cast("long")

    ranged = (counted.withColumn("sure", reach(F.col("seats") - F.col("n") / 2))
              .withColumn("most", F.greatest("sure", reach(F.col("seats") + F.col("n") / 2)))
              .withColumn("open", F.col("seats") - F.sum("sure").over(whole)))
    tried = (ranged.filter("most > sure")
             .withColumn("i", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))))
             .withColumn("place", F.row_number().over(whole.orderBy(
                 F.desc(F.col("votes") / (2 * F.col("i") - 1)), *order, "i")))
             .filter(F.col("place") <= F.col("open")))
    won = tried.groupBy(*order).agg(F.count(F.lit(1)).alias("won"))
    return ranged.join(won, order, "left").select(
        *parties.columns, (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        row_id: str | None = None, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
        seed: int = SEED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``, and the words taken.

    ``passes`` counts how often the whole document is taken; ``from_word``, ``to_word`` and ``from_word_2``,
    ``to_word_2`` are the one or two runs of its words that are taken once more (empty when equal). Documents
    of a source are dealt to shards, one for every ``shard_rows`` of the source's rows, and laid end to end in a seeded
    order; a shard's words fall into blocks of ``block_words``. Sainte-Laguë gives each source a whole number of
    words by its target, and each of its shards a whole number of blocks by its words. What blocks leave over, a last part
    of a block and what a shard cannot hold, goes to the first shards with room, in a seeded order, so each source meets
    its target to a word or so. A quota takes the whole shard as often as it can and then the words of neighbouring blocks
    from a seeded first block on, around the end if need be. No document is taken more than ``most`` times.
    Null and empty texts have size 0 and are never taken; a null source is a source of its own;
    repeated rows count each; an empty table gives no rows. Reruns agree for distinct rows.
    """
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    base = stored(docs.select(F.col(id_col).alias("id"), rid.alias("rid"), F.col(source_col).isNull().alias("no_source"),
                              F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                              F.coalesce(words(F.col(text_col)), F.lit(0)).alias("size"),
                              F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("seeded")), "mixing")
    name = ["no_source", "source"]
    # Stored, so that the join can split a source that has very many rows.
    parts = stored(base.groupBy(*name).agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts")), "mixing-sources")
    dealt = base.join(parts, name).withColumn("shard", F.pmod(F.xxhash64("seeded"), F.col("parts")).cast("int")).drop("parts")
    cells = stored(dealt.groupBy(*name, "shard").agg(F.sum("size").alias("votes")), "mixing-cells")
    goals = targets(cells.groupBy(*name).agg(F.sum("votes").alias("source_size")), weights, most)
    # Full sources take all they may; the others share the words that are left.
    limit, whole = F.col("source_size") * most, Window.partitionBy()
    full = F.col("target") >= limit
    parties = goals.withColumn("votes", F.when(full, 0.0).otherwise(F.col("target"))).withColumn(
        "seats", F.sum(F.col("source_size") - F.when(full, limit).otherwise(F.lit(0))).over(whole).cast("long"))
    goals = stored(sainte_lague(parties, [], name).select(
        *name, "source_size", "target", F.when(full, limit).otherwise(F.least("quota", limit)).cast("long").alias("words")),
        "mixing-goals").withColumn("seats", F.floor(F.col("words") / block_words))
    same, held = Window.partitionBy(*name), F.col("votes") * most
    before = same.orderBy(F.xxhash64(F.lit(seed), "source", "shard"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (sainte_lague(cells.join(goals, name), name, [*name, "shard"])
              .withColumn("share", F.least(F.col("quota") * block_words, held))
              .withColumn("left", F.col("words") - F.sum("share").over(same)
                          - F.coalesce(F.sum(held - F.col("share")).over(before), F.lit(0)))
              .withColumn("share", F.col("share") + F.greatest(F.least(F.col("left"), held - F.col("share")), F.lit(0)))
              .withColumn("blocks", F.greatest(F.ceil(F.col("votes") / block_words), F.lit(1)))
              .withColumn("passes", F.when(F.col("votes") > 0, F.floor(F.col("share") / F.col("votes"))).otherwise(F.lit(0)))
              .withColumn("extra", F.col("share") - F.col("passes") * F.col("votes"))
              .withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), "blocks") * block_words)
              .withColumn("stop", F.least(F.col("start") + F.col("extra"), F.col("votes")))
              .withColumn("wrapped", F.greatest(F.col("start") + F.col("extra") - F.col("votes"), F.lit(0)))
              .select(*name, "shard", "source_size", "target", "passes", "start", "stop", "wrapped"))
    line = Window.partitionBy(*name, "shard").orderBy("seeded", "id", "size", "rid")
    laid = dealt.withColumn("stops", F.sum("size").over(line)).withColumn("starts", F.col("stops") - F.col("size"))
    met = laid.join(quotas, [*name, "shard"])

    def within(at: Column) -> Column:
        return F.least(F.greatest(at - F.col("starts"), F.lit(0)), F.col("size")).cast("long")

    runs = met.select(
        "id", "rid", "size", "source_size", "target", F.col("passes").cast("long").alias("passes"),
        within(F.col("start")).alias("from_word"), within(F.col("stop")).alias("to_word"),
        F.lit(0).cast("long").alias("from_word_2"), within(F.col("wrapped")).alias("to_word_2"))
    taken = F.col("passes") * F.col("size") + F.col("to_word") - F.col("from_word") + F.col("to_word_2")
    return runs.select(F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target",
                       taken.alias("taken"), "passes", "from_word", "to_word", "from_word_2", "to_word_2",
                       F.col("rid").alias("row_id"))


def mixed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken, then the runs of it that are taken once more.

    Columns as in ``docs``; a run keeps the white space inside it. A repeated document repeats its row.
    """
    rows, rid = numbered(docs, "mixing-rows")
    m, piece = fresh(rows, "mix"), fresh(rows, "piece")
    plan = mix(rows, row_id=rid).select(F.col("row_id").alias(rid), "taken", "passes", "from_word", "to_word", "to_word_2")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{BLANK}*[^\\x20\\x09-\\x0D]+"), 0)

    def run(start: Column, stop: Column) -> Column:
        part = F.array_join(F.slice(pieces, (start + 1).cast("int"), (stop - start).cast("int")), "")
        return F.when(stop > start, F.regexp_replace(part, f"^{BLANK}+", ""))

    whole = F.when(F.col(f"{m}.passes") > 0, F.array_repeat(F.col(text_col), F.col(f"{m}.passes").cast("int")))
    parts = F.filter(F.array(run(F.col(f"{m}.from_word"), F.col(f"{m}.to_word")), run(F.lit(0), F.col(f"{m}.to_word_2"))),
                     lambda t: t.isNotNull())
    texts = F.concat(F.coalesce(whole, F.array().cast("array<string>")), parts)
    return beside(rows, rid, plan, m).filter(F.col(f"{m}.taken") > 0).withColumn(piece, F.explode(texts)).select(
        *[F.col(piece).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
