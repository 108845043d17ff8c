"""Exact Jaccard join of word shingle sets with grouped prefixes, and its connected components."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from premia.llm.common import among, beside, components, discard, fresh, numbered, scratch, small_batches, stored, text_of
from premia.llm.shingles import binaries, mix64, shingle_sets

#: The least similarity as a fraction.
LEAST = (4, 5)
#: Shingles that so many rows have are told apart by how many rows have them.
HOT_LEAST = 16
#: Bits of a shingle that say its place in the table of ranks, a byte each.
_SLOT_BITS = 24


def prefix_length(n: int) -> int:
    """Two sets of that size or less, similar enough, share one of so many first elements in any common order."""
    return n - -(-n * LEAST[0] // LEAST[1]) + 1 if n else 0


def overlap_needed(n: Column, m: Column) -> Column:
    """The least common elements of two similar sets."""
    return F.ceil((n + m) * LEAST[0] / float(LEAST[0] + LEAST[1]) - 1e-9)


def tokens_of(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shingles as ordering tokens, rare ones first: 62 bits, so that they are positive longs."""
    rank = ranks[(shingles >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)]
    return (shingles >> np.uint64(2))[np.argsort(rank, kind="stable")]


def frequency_ranks(rows: DataFrame, total: int) -> np.ndarray:
    """For each slot of shingles (their first bits) a rank, from all shingles of all rows: the more rows, the larger.

    Shingles are counted by cells, some four for each shingle as long as they are few, and a slot's rank is that of its
    largest cell; below ``HOT_LEAST`` rows it is 0. Tasks hand on their cells sorted, as the gaps between them (two bytes a
    shingle), and the driver sees the ranks, 16 MB for any number of rows. With frequent shingles last in the order, each after
    the rarer ones, hardly any rows meet by chance. The order decides only how many candidates there are.
    """
    bits = min(32, max(_SLOT_BITS, (512 * total).bit_length() + 2))
    part_bits = min(16, max(8, (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()))
    span, least = 1 << (bits - part_bits), HOT_LEAST

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cell = np.sort(np.concatenate(held or [np.zeros(0, np.uint32)])).astype(np.int64)
            held.clear()
            part = cell >> (bits - part_bits)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            gap = np.diff(cell, prepend=0)
            gap[at] = cell[at] & (span - 1)
            wide = bool(len(gap)) and int(gap.max()) >= 1 << 16
            gap = gap.astype(np.uint32 if wide else np.uint16)
            return pa.RecordBatch.from_pydict({
                "part": pa.array(part[at], pa.int64()), "wide": pa.array([wide] * len(at), pa.bool_()),
                "gaps": pa.array([g.tobytes() for g in np.split(gap, at[1:])] if len(at) else [], pa.binary())})

        for batch in batches:
            for shingles in shingle_sets(binaries(batch.column(0))):
                held.append((shingles >> np.uint64(64 - bits)).astype(np.uint32))
                size += len(shingles)
                if size >= 4_000_000:
                    yield flush()
                    size = 0
        yield flush()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, now = np.zeros(span, np.uint32), None

        def row() -> pa.RecordBatch:
            most = counts.reshape(-1, 1 << (bits - _SLOT_BITS)).max(axis=1)
            ranks = np.where(most < least, 0, np.log2(np.maximum(most, 1))).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int64()), "ranks": pa.array([ranks.tobytes()], pa.binary())})

        for batch in batches:
            for part, wide, gaps in zip(*[c.to_pylist() for c in batch.columns]):
                if now not in (None, part):
                    yield row()
                    counts[:] = 0
                now = part
                np.add.at(counts, np.cumsum(np.frombuffer(gaps, np.uint32 if wide else np.uint16), dtype=np.int64), np.uint32(1))
        if now is not None:
            yield row()

    found = stored(rows.select("text").mapInArrow(cells, "part long, wide boolean, gaps binary")
                   .repartition("part").sortWithinPartitions("part").mapInArrow(rank, "part long, ranks binary"), "jaccard-ranks")
    ranks = np.zeros((1 << part_bits, 1 << (_SLOT_BITS - part_bits)), np.uint8)
    for part, own in found.collect():
        ranks[part] = np.frombuffer(own, np.uint8)
    return ranks.reshape(-1)


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of four to eight bits a shingle; each shingle flips one bit."""
    bits = max(64, 1 << (4 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(rows: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(rid, id, n, s1, s2, p1, p2, prefix, odd): size, digests of the set and of the prefix, the prefix, parities."""

    def digests(values: np.ndarray) -> tuple[int, int]:
        return (int(mix64(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)),
                int(mix64(values + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).astype(np.int64)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shingles in shingle_sets(binaries(batch.column(2))):
                prefix = tokens_of(shingles, ranks)[:prefix_length(len(shingles))]
                out.append((len(shingles), *digests(shingles), *digests(prefix), prefix.astype(np.int64), parities(shingles)))
            n, s1, s2, p1, p2, prefix, odd = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()),
                 *[pa.array(c, pa.int64()) for c in (n, s1, s2, p1, p2)],
                 *[pa.array(c, pa.list_(pa.int64())) for c in (prefix, odd)]],
                names=["rid", "id", "n", "s1", "s2", "p1", "p2", "prefix", "odd"])

    return rows.select("rid", "id", "text").mapInArrow(
        sketch, "rid long, id long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>, odd array<long>")


def full_sets(docs: DataFrame, rid: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(c, set): all shingles of the texts of ``wanted`` (c), sorted; ``docs`` are numbered and stay where they are."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.astype(np.int64) for s in shingle_sets(binaries(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["c", "set"])

    return (among(docs, rid, wanted.select(F.col("c").alias(rid))).select(rid, text_of(text_col).alias("text"))
            .mapInArrow(whole, "c long, set array<long>"))


def least_difference(a: Column, b: Column) -> Column:
    """Elements that are in one of two sets only are at least as many as their parities differ.

    Close sizes have bitmaps of equal or double length; the halves of the longer one are laid over each other.
    """
    def folded(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        twice = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), twice).otherwise(x)

    differ = F.zip_with(folded(a, b), folded(b, a), lambda p, q: p.bitwiseXOR(q))
    return F.aggregate(differ, F.lit(0), lambda n, x: n + F.bit_count(x))


def may_link(pairs: DataFrame, odd: DataFrame) -> DataFrame:
    """``pairs`` of classes (a, b) whose ``odd`` (c, n, odd) leave room for enough common shingles."""
    left = odd.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    right = odd.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    most = (F.col("na") + F.col("nb") - least_difference(F.col("oa"), F.col("ob"))) / 2
    return (pairs.distinct().join(left, "a").join(right, "b")
            .filter(close_in_size(F.col("na"), F.col("nb")) & (most >= overlap_needed(F.col("na"), F.col("nb"))))
            .select("a", "b"))


def verified(pairs: DataFrame, odd: DataFrame, sets_of: Callable[[DataFrame], DataFrame], purpose: str) -> DataFrame:
    """``pairs`` of classes (a, b) whose whole sets are similar enough, stored; what is stored on the way is deleted."""
    inner: list[str] = []
    with scratch(inner):
        pairs = stored(may_link(pairs, odd), "jaccard-pairs")
        sets = stored(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()), "jaccard-sets")
    met = (pairs.join(sets.select(F.col("c").alias("b"), F.col("set").alias("right")), "b")
           .join(sets.select(F.col("c").alias("a"), F.col("set").alias("left")), "a"))
    common = F.size(F.array_intersect("left", "right"))
    links = stored(met.filter(common >= overlap_needed(F.size("left"), F.size("right"))).select("a", "b"), purpose)
    discard(pairs.sparkSession, inner)
    return links


def close_in_size(n: Column, m: Column) -> Column:
    return F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]


def early(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of sizes n and m that share their places at and to first can still be similar."""
    return F.least(n - at, m - to) >= overlap_needed(n, m)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``row_id``, ``root`` (a row of the component).

    Documents with equal sets are one class; classes with equal size and equal prefix (the first shingles in a common
    order, frequent ones last) are one group. In a first round each group meets only the group that has the
    token earliest, that is with fewest rare shingles before it, on each of its prefix tokens, and each class of a group the group's first class; links found there already join
    most copies. In the second round all groups that share a prefix token meet, except where the classes are in one
    component by now, so large families of copies are not paired again. Pairs of groups must pass a bound
    from their sizes and the places of the shared token; then they are expanded to classes, which must pass a
    bound from a bitmap of the whole set, and whole sets are compared. Both bounds only drop pairs that cannot be similar
    enough, so no link between different components is missed.

    ``docs`` with a ``row_id`` are those of ``numbered``. Whole texts are not shuffled.

    Null texts and texts without words have no shingles and are linked with nothing; fewer than five words
    are one shingle. ``component_id`` is the smallest id of the component, null only if all its ids are. Rows
    that repeat an id are documents each; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    if not row_id:
        docs, row_id = numbered(docs.select(id_col, text_col), "jaccard-rows")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(row_id).alias("rid"), text_of(text_col).alias("text"))
    sets_of = functools.partial(full_sets, docs, row_id, text_col)
    sketch = stored(sketches(rows, frequency_ranks(rows, rows.count())), "jaccard-sketches")
    full = sketch.filter("n > 0")
    same_set, same_prefix = ["n", "s1", "s2"], ["n", "p1", "p2"]
    classes = stored(full.groupBy(*same_set).agg(F.min("rid").alias("c"), F.first("p1").alias("p1"), F.first("p2").alias("p2")), "jaccard-classes")
    groups = stored(classes.groupBy(*same_prefix).agg(F.min("c").alias("g")), "jaccard-groups")
    members = stored(classes.join(groups, same_prefix).select("c", "g"), "jaccard-members")
    odd = sketch.select(F.col("rid").alias("c"), "n", "odd")
    tokens = (sketch.join(groups.select("g"), F.col("rid") == F.col("g"), "left_semi")
              .select(F.col("rid").alias("g"), "n", F.posexplode("prefix").alias("at", "token")))

    shared = stored(sketch.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("size"))
                    .filter("size > 1").select("token"), "jaccard-shared")
    # Only tokens that two documents have can make a link; every later step reads these postings.
    posts = stored(tokens.join(shared, "token").select("token", "g", "n", "at"), "jaccard-posts")
    banded = posts.withColumn("band", F.floor(F.log(F.col("n")) / float(np.log(LEAST[1] / LEAST[0]))))
    first = stored(banded.groupBy("token", "band").agg(F.min(F.struct("at", "g", "n")).alias("f"), F.count(F.lit(1)).alias("size"))
                   .filter("size > 1").drop("size"), "jaccard-first")
    stars = (banded.join(first, ["token", "band"])
             .filter((F.col("f.g") != F.col("g")) & close_in_size(F.col("f.n"), F.col("n"))
                     & early(F.col("f.n"), F.col("f.at"), F.col("n"), F.col("at")))
             .select(F.least("f.g", "g").alias("a"), F.greatest("f.g", "g").alias("b")).distinct())
    inside = members.filter("c <> g").select(F.col("g").alias("a"), F.col("c").alias("b"))
    links = verified(stars.unionByName(inside), odd, sets_of, "jaccard-links")

    found = components(links, "jaccard-components")
    labels = stored(members.join(found, F.col("c") == F.col("node"), "left")
                    .select("c", "g", F.coalesce("component", "c").alias("k")), "jaccard-labels")
    mixed = labels.groupBy("g", "k").agg(F.min("c").alias("any"))
    posts = posts.join(mixed.select("g", "k"), "g")
    open_ = stored(posts.groupBy("token").agg(F.min("k").alias("low"), F.max("k").alias("high"))
                   .filter("low < high").select("token"), "jaccard-open")
    posts = stored(posts.join(open_, "token").select("token", "g", "k", "n", "at"), "jaccard-open-posts")
    left, right = posts.alias("l"), posts.alias("r")
    n, m = F.col("l.n"), F.col("r.n")
    across = (left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.k") < F.col("r.k")) & close_in_size(n, m)
                        & early(n, F.col("l.at"), m, F.col("r.at")))
              .select(F.col("l.g").alias("ga"), F.col("l.k").alias("ka"), F.col("r.g").alias("gb"), F.col("r.k").alias("kb")).distinct())
    pairs = (across.join(labels.select(F.col("g").alias("ga"), F.col("k").alias("ka"), F.col("c").alias("a")), ["ga", "ka"])
             .join(labels.select(F.col("g").alias("gb"), F.col("k").alias("kb"), F.col("c").alias("b")), ["gb", "kb"])
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    more = verified(pairs, odd, sets_of, "jaccard-links-2")

    joined = components(more.join(labels.select(F.col("c").alias("a"), F.col("k").alias("ka")), "a")
                        .join(labels.select(F.col("c").alias("b"), F.col("k").alias("kb")), "b")
                        .select(F.col("ka").alias("a"), F.col("kb").alias("b")), "jaccard-components")
    roots = stored(labels.join(joined, F.col("k") == F.col("node"), "left")
                   .select("c", F.coalesce("component", "k").alias("root")), "jaccard-roots")
    placed = stored(full.drop("prefix", "p1", "p2").join(classes.select(*same_set, "c"), same_set).join(roots, "c")
                    .select("rid", "id", "n", "root"), "jaccard-placed")
    least = stored(placed.groupBy("root").agg(F.min("id").alias("component_id")), "jaccard-least")
    linked = placed.join(least, "root").select("id", "n", "component_id", "rid", "root")
    alone = sketch.filter("n = 0").select("id", "n", F.col("id").alias("component_id"), "rid", F.col("rid").alias("root"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("rid").alias("row_id"), "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row for each component, that of the smallest id; rows without words all stay, each its own.

    The tables of the join are deleted as soon as the rows that stay are known. Whole texts are not shuffled.
    """
    rows, rid = numbered(docs, "jaccard-documents")
    inner: list[str] = []
    with scratch(inner):
        found = jaccard_components(rows, id_col=id_col, row_id=rid)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("row_id").alias("rid"))
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.rid").alias("row_id"), F.lit(True).alias("kept"))
    marked = stored(found.select("row_id").join(first, "row_id", "left").select(F.col("row_id").alias(rid), "kept"), "jaccard-first-rows")
    discard(docs.sparkSession, inner)
    fact = fresh(rows, "fact")
    return beside(rows, rid, marked, fact).filter(F.col(f"{fact}.kept")).select(docs.columns)
