"""Product codes of integer vectors, assigned exactly with LAESA pivots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from premia.llm.common import small_batches, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 3
SCALE = 256
LARGEST = (1 << 63) - 1
#: Squared distances below this are exact as doubles and as 64-bit integers.
EXACT = 1 << 52


def edges(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end: equal if ``parts`` divides the width, else one apart at most."""
    return [p * width // parts for p in range(parts + 1)]


def far_apart(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Pivots of one part position: its first entry, then each time the entry farthest from those chosen."""
    chosen = [0]
    gap = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(entries)):
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def wide(*arrays: np.ndarray) -> bool:
    """Whether squared distances between these vectors may leave the range of exact doubles."""
    most = max(max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in arrays)
    return 4 * most * most * max(max((a.shape[-1] for a in arrays), default=1), 1) >= EXACT


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and rows that stand at the same place, or of rows and one vector."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances, not squared, of each part to the fixed pivots of its position."""
    return np.stack([np.sqrt(squared(x, p).astype(float)) for p in pivots], axis=1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each part, ties to the lower index.

    No entry is nearer than the largest difference between its own and the part's distance to a pivot. Entries are
    tried in the order of that bound; a part is done once the next bound is above its best distance. Bounds
    are lowered by more than rounding can have raised them, and distances are whole numbers, so results are exact.
    """
    apart = pivot_distances(entries, pivots)
    low = np.zeros((len(x), len(entries)))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(to_pivots[:, p, None] - apart[None, :, p]), out=low)
    low -= 1e-9 * (1 + to_pivots.max(axis=1, initial=0)[:, None] + apart.max(initial=0))
    order = np.argsort(low, axis=1, kind="stable")
    low = np.square(np.maximum(np.take_along_axis(low, order, axis=1), 0))
    rows = np.arange(len(x))
    best = order[:, 0].copy()
    error = squared(x, entries[best])
    for turn in range(1, len(entries)):
        rows = rows[low[rows, turn] <= error[rows].astype(float)]
        if not len(rows):
            break
        at = order[rows, turn]
        found = squared(x[rows], entries[at])
        better = (found < error[rows]) | ((found == error[rows]) & (at < best[rows]))
        best[rows[better]], error[rows[better]] = at[better], found[better]
    return best, error


class Codebooks:
    """Entries and fixed pivots of every part position, for vectors of one width."""

    def __init__(self, first: np.ndarray, parts: int, pivots: int):
        self.cuts = edges(first.shape[1], parts)
        self.entries = [first[:, a:b].copy() for a, b in zip(self.cuts, self.cuts[1:])]
        self.pivots = [far_apart(e, pivots) for e in self.entries]

    def matrix(self, rows: list) -> np.ndarray:
        """Vectors as integers of 64 bits, or as Python's where squares could outgrow them."""
        x = np.array(rows, dtype=np.int64).reshape(len(rows), self.cuts[-1])
        return x.astype(object) if wide(x, *self.entries, *self.pivots) else x

    def pivot_table(self, x: np.ndarray) -> np.ndarray:
        """Distances of all parts to their pivots: (vectors, positions, pivots)."""
        return np.stack([pivot_distances(x[:, a:b], p) for a, b, p in zip(self.cuts, self.cuts[1:], self.pivots)], axis=1)

    def assign(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared errors: (vectors, positions)."""
        found = [nearest(x[:, a:b], table[:, at], self._as(x, e), self._as(x, p))
                 for at, (a, b, e, p) in enumerate(zip(self.cuts, self.cuts[1:], self.entries, self.pivots))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    @staticmethod
    def _as(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return own.astype(x.dtype)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for e in self.entries for row in e for c in row).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(row, id, label, x, width): floor(scale * component) as longs, without vectors that are null or not finite."""
    sound = F.col(vector_col).isNotNull() & ~F.exists(
        vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    largest = F.lit(float(1 << 62))
    whole = F.transform(vector_col, lambda c: F.floor(F.greatest(-largest, F.least(largest, c.cast("double") * F.lit(float(scale))))).cast("long"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole.alias("x"), F.size(vector_col).alias("width"))


def by_width(batch: pa.RecordBatch, books: dict[int, Codebooks]) -> Iterator[tuple[Codebooks, np.ndarray, np.ndarray, np.ndarray]]:
    """Codebooks, rows of the batch, vectors and distances to pivots, for each width in the batch."""
    widths = batch.column("width").to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        at, book = np.flatnonzero(widths == width), books[int(width)]
        part = batch.take(pa.array(at))
        x = book.matrix(part.column("x").to_pylist())
        table = (np.array(part.column("apart").to_pylist(), dtype=float).reshape(len(at), len(book.entries), -1)
                 if "apart" in batch.schema.names else np.zeros((len(at), 0, 0)))
        yield book, at, x, table


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> DataFrame:
    """One row per usable vector: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Vectors that are null or hold null or non-finite components go. Codebooks start from the parts of the ``entries``
    smallest ids (a null id comes last; rows that repeat an id follow each other by their components); after each of ``rounds``
    assignments an entry becomes the floor of its parts' mean, an unused one stays. Pivots are chosen among the first
    entries and stay, so each part's distances to them are computed once and stored with the vector. Vectors of
    another width have codebooks of their own; parts of a width that ``parts`` does not divide differ by one component.
    Components stop at 2**62 on both sides, errors at the largest long. A label's errors are added up over all its rows,
    nulls together. Extra columns are ignored; an empty table gives no rows.

    The driver and each task see the codebooks only: ``entries`` vectors for each width.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    kept = stored(usable(vectors, id_col, vector_col, label_col, scale), "vector-codes")
    # A ranking limit that prunes in each task, before anything is shuffled.
    smallest = Window.partitionBy("width").orderBy(F.col("id").asc_nulls_last(), "x")
    first = (kept.select("id", "x", "width").withColumn("place", F.row_number().over(smallest))
             .filter(F.col("place") <= entries).orderBy("width", "place").select("width", "x").collect())
    starts: dict[int, list] = {}
    for row in first:
        starts.setdefault(row["width"], []).append(row["x"])
    books = {}
    for width, rows in starts.items():
        start = np.array(rows, dtype=np.int64).reshape(len(rows), width)
        books[width] = Codebooks(start.astype(object) if wide(start) else start, parts, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart: list = [None] * batch.num_rows
            for book, at, x, _ in by_width(batch, books):
                for i, row in zip(at, book.pivot_table(x).reshape(len(at), -1)):
                    apart[i] = row.tolist()
            yield batch.append_column("apart", pa.array(apart, pa.list_(pa.float64())))

    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    measured = stored(kept.mapInArrow(measure, ", ".join(f"{c} {t}" for c, t in types.items()) + ", apart array<double>"),
                      "vector-codes-pivots")
    for _ in range(rounds):
        _move(measured.select("x", "width", "apart"), books)
    digests = {width: book.digest() for width, book in books.items()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for book, at, x, table in by_width(batch, books):
                codes, errors = book.assign(x, table)
                for i, code, error in zip(at, codes, errors):
                    out[i] = bytes(code.astype(np.uint8)).hex(), min(int(error.sum()), LARGEST), digests[book.cuts[-1]]
            code, error, digest = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64()),
                 pa.array(digest, pa.string())], ["id", "label", "code", "error", "codebooks_sha256"])

    coded = stored(measured.select("id", "label", "x", "width", "apart").mapInArrow(
        encode, f"id {types['id']}, label {types['label']}, code string, error long, codebooks_sha256 string"), "vector-codes-out")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("same")).agg(total.alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def _move(measured: DataFrame, books: dict[int, Codebooks]) -> None:
    """Assign every part and put each entry at the floor of its parts' mean. Tasks hand on sums for each entry."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for book, _, x, table in by_width(batch, books):
                codes, _ = book.assign(x, table)
                for p, (a, b) in enumerate(zip(book.cuts, book.cuts[1:])):
                    used, where = np.unique(codes[:, p], return_inverse=True)
                    total = np.zeros((len(used), b - a), dtype=object)
                    for k in range(b - a):
                        total[:, k] = _sums(where, x[:, a + k], len(used))
                    many = np.bincount(where, minlength=len(used))
                    for entry, row, n in zip(used, total, many):
                        old = sums.setdefault((book.cuts[-1], p, int(entry)), [0, [0] * (b - a)])
                        old[0] += int(n)
                        old[1] = [s + int(t) for s, t in zip(old[1], row)]
        rows = [(w, p, e, n, k, str(s)) for (w, p, e), (n, total) in sums.items() for k, s in enumerate(total)]
        if rows:
            columns = list(zip(*rows))
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["width", "part", "entry", "n", "at", "total"])

    summed = (measured.mapInArrow(add_up, "width int, part int, entry int, n long, at int, total string")
              .groupBy("width", "part", "entry", "at")
              .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    for row in summed.collect():
        books[row["width"]].entries[row["part"]][row["entry"], row["at"]] = int(row["total"]) // row["n"]


def _sums(where: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums of whole numbers by group."""
    if values.dtype != object:
        return np.bincount(where, weights=values.astype(float), minlength=groups).astype(np.int64)
    out = np.zeros(groups, dtype=object)
    np.add.at(out, where, values)
    return out
