"""Shards of equal counts that keep linked documents together: balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from premia.llm.common import ranked, stored, text_of

GRAINS = 256
# A link of at most this part of a shard starts whole in one shard; larger ones start scattered.
WHOLE = 16


def propagate(members: DataFrame, shards: int, capacity: int, rounds: int | None = None, grains: int = GRAINS) -> DataFrame:
    """(rid, shard) for all of ``members`` (rid, link, shard), each row of which ties a document to a link.

    A link ties all its documents to each other, so a pair is a link of two and a group of copies one link of
    many; pairs are never listed. A document starts in the shard of its smallest link. In each round it counts the
    members of its links by shard (one small row for each link and shard, summed before the shuffle) and
    asks for the shard with most of them that has room; in a tie open shards come first, then a hash of its first
    link and the round decides, alike for all members. A shard takes in its askers in a seeded order of gain,
    exactly up to ``capacity``: whole grains, then part of the first grain that does not fit.

    Without ``rounds`` it goes on until no document moves. The sum of squared votes never falls, whichever askers get in,
    as a document votes for itself too; each gain lifts it, so a round that leaves it alone is
    followed by rounds of gains only, and these come to an end.
    """
    labels = stored(members.groupBy("rid").agg(F.min_by("shard", "link").alias("shard")), "shard-labels")
    ties = members.select("rid", "link")
    turn, together, ties_too = 0, -1, True
    while rounds is None or turn < rounds:
        placed = ties.join(labels, "rid")
        votes = placed.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("votes"))
        # One row a shard.
        room = (labels.groupBy("shard").agg((F.lit(capacity) - F.count(F.lit(1))).alias("room"))
                .withColumnRenamed("shard", "to"))
        # A link has as many votes as there are shards at most; stored, so that the join can split a hot link.
        tally = stored(votes.groupBy("link").agg(F.collect_list(F.struct("shard", "votes")).alias("tally")), "shard-votes")
        squares = F.aggregate("tally", F.lit(0).cast("decimal(38,0)"), lambda n, t: (
            n + t["votes"].cast("decimal(18,0)") * t["votes"].cast("decimal(18,0)")).cast("decimal(38,0)"))
        last, together = together, tally.agg(F.sum(squares)).first()[0] or 0
        ties_too = ties_too and together > last
        near = (placed.join(tally, "link").select("rid", "shard", "link", F.explode("tally").alias("t"))
                .groupBy("rid", "shard", F.col("t.shard").alias("to"))
                .agg(F.sum("t.votes").alias("votes"), F.min("link").alias("link"))
                .join(F.broadcast(room), "to", "left").filter("to = shard OR room > 0"))
        best = F.max(F.struct("votes", (F.col("room") > 0).alias("open"),
                              F.xxhash64(F.lit(turn), "link", "to").alias("toss"), "to"))
        asked = stored(
            near.groupBy("rid", "shard")
            .agg(best.alias("best"), F.max(F.when(F.col("to") == F.col("shard"), F.col("votes"))).alias("here"))
            .filter("best.to <> shard")
            .select("rid", F.col("best.to").alias("to"),
                    F.when(F.col("best.votes") > F.col("here"), 0).otherwise(1).alias("late"))
            .filter(F.lit(ties_too) | (F.col("late") == 0))
            .withColumn("grain", F.col("late") * grains + F.pmod(F.xxhash64(F.lit(turn), "rid"), F.lit(grains))), "shard-askers")
        # An open shard takes in one of its askers at least, so all is settled only when nobody asks.
        if asked.isEmpty():
            break
        # At most 2 * grains rows for each shard, however many documents ask.
        line = Window.partitionBy("to").orderBy("grain")
        book = stored(asked.groupBy("to", "grain").agg(F.count(F.lit(1)).alias("askers"))
                      .withColumn("upto", F.sum("askers").over(line))
                      .join(F.broadcast(room), "to")
                      .select("to", "grain", (F.col("room") - F.col("upto") + F.col("askers")).alias("places"), "askers")
                      .filter("places > 0"), "shard-grains")
        whole = asked.join(F.broadcast(book.filter("askers <= places").select("to", "grain")), ["to", "grain"])
        # One grain of a shard at most.
        part = stored(asked.join(F.broadcast(book.filter("askers > places").select("to", "grain", "places")), ["to", "grain"])
                      .select("rid", "to", "places"), "shard-part")
        part = ranked(part, ["to"], ["rid"], "place").filter("place < places")
        moved = whole.select("rid", "to").unionByName(part.select("rid", "to"))
        labels = stored(labels.join(moved, "rid", "left").select("rid", F.coalesce("to", "shard").alias("shard")), "shard-labels")
        turn += 1
    return labels


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: DataFrame | None = None,
                    shards: int = 8, rounds: int | None = None) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``rows``: counts of shards differ by one at most. ``links`` (id, link) names the documents that
    belong together; by default those with equal texts do. Null and empty texts both have size 1 and
    the same checksum but are linked with nothing. Linked documents settle by label propagation (``rounds`` bounds
    it; by default it goes on until nothing moves), at most an even share in a shard; then documents in excess, those without links first, fill up the other shards
    exactly. A link with more documents than a shard holds is split over several. Rows that
    repeat an id count each. An empty table gives no rows. ``grown_shard`` is null, as it belongs to another law.
    """
    text = text_of(text_col)
    base = stored(docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(text != "", F.xxhash64(text)).alias("same")), "sharding")
    rows = base.count()
    if links is None:
        ties = base.filter("same IS NOT NULL").select("rid", F.col("same").alias("link"))
    else:
        named = links.select(links.columns[0], links.columns[1]).toDF("id", "link").filter("link IS NOT NULL")
        ties = base.join(named, "id").select("rid", F.xxhash64(F.col("link")).alias("link"))
    groups = stored(ties.groupBy("link").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "shard-links")
    start = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    first = F.when(F.col("members") * WHOLE <= rows // shards, F.pmod(F.xxhash64("link"), F.lit(shards)).cast("int")).otherwise(start)
    members = stored(ties.join(groups, "link").withColumn("shard", first).drop("members"), "shard-ties")
    labels = propagate(members, shards, rows // shards, rounds)
    placed = (base.join(labels.withColumnRenamed("shard", "label"), "rid", "left")
              .withColumn("linked", F.col("label").isNotNull().cast("int"))
              .withColumn("label", F.coalesce("label", start)))
    return even_out(placed, shards, rows).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def even_out(placed: DataFrame, shards: int, rows: int) -> DataFrame:
    """``placed`` (rid, label, linked) with ``shard`` and ``slot``: counts one apart at most, few rows moved.

    Rows are ranked in their shard, linked ones first. Ranks below the shard's quota are slots; the surplus is numbered
    across shards and falls, by running counts of eight rows a side, into the free slots of the others.
    """
    session = placed.sparkSession
    kinds = ranked(placed, ["label", "linked"], ["rid"], "place")
    kinds = stored(kinds, "shard-ranks")
    held = kinds.groupBy("label").agg(F.count(F.lit(1)).alias("held"), F.sum("linked").alias("tied"))
    every = session.range(shards).select(F.col("id").cast("int").alias("label"))
    quota = F.lit(rows // shards) + (F.col("label") < rows % shards).cast("long")
    running = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    book = (every.join(held, "label", "left").na.fill(0, ["held", "tied"]).withColumn("quota", quota)
            .withColumn("over", F.greatest(F.col("held") - F.col("quota"), F.lit(0)))
            .withColumn("free", F.greatest(F.col("quota") - F.col("held"), F.lit(0)))
            .withColumn("over_before", F.coalesce(F.sum("over").over(running), F.lit(0)))
            .withColumn("free_before", F.coalesce(F.sum("free").over(running), F.lit(0))))
    seated = kinds.join(F.broadcast(book.drop("free", "free_before")), "label").withColumn(
        "place", F.when(F.col("linked") == 1, F.col("place")).otherwise(F.col("place") + F.col("tied")))
    stay = seated.filter("place < quota").withColumn("shard", F.col("label")).withColumn("slot", F.col("place"))
    spare = F.broadcast(book.filter("free > 0").select(
        F.col("label").alias("shard"), F.col("held").alias("next"), "free", F.col("free_before").alias("lot")))
    go = seated.filter("place >= quota").withColumn("number", F.col("over_before") + F.col("place") - F.col("quota"))
    gone = (go.join(spare, (F.col("number") >= F.col("lot")) & (F.col("number") < F.col("lot") + F.col("free")))
            .withColumn("slot", F.col("next") + F.col("number") - F.col("lot")))
    keep = [*placed.columns, "shard", "slot"]
    return stay.select(keep).unionByName(gone.select(keep))
