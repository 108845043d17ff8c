"""Pack tokenised documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from operator import add
from string import ascii_lowercase, ascii_uppercase, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from premia.llm.common import beside, numbered, ranked, small_batches, text_of

SEQUENCE = 4096
GRAIN = 8
END_ID = 2
CACHE_WORDS = 1_200_000
TOGETHER = 1 << 20
BETWEEN = "<|endoftext|>"

_tokenizers: dict = {}


class Words:
    """A tokenizer and the ids of the words it has met, once per Python worker.

    The tokenizer never joins over white space, so a word's ids are looked up after the first time. Where it
    parts letters from what follows them, a word's letters and its closing punctuation are encoded apart, so that
    the forms of a word that differ in punctuation (and in ASCII case, if the tokenizer ignores it) cost once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.parts = {"": b""}
        shape, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lowers = shape is not None and shape.normalize_str(ascii_uppercase) == ascii_lowercase
        self.ends = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and split is not None and all(
                len(split.pre_tokenize_str(f"a{c}")) == 2 for c in (*punctuation, punctuation)):
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.sizes = np.zeros(len(self.ends), np.int64)
            for token, i in vocabulary.items():
                self.sizes[i] = len(token.removesuffix(suffix))

    def _normal(self, word: str) -> str:
        """The word as the tokenizer sees it."""
        shape = self.tokenizer.normalizer
        return word if shape is None or (word.isascii() and self.lowers) else shape.normalize_str(word)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _marked(self, words: list[str]) -> list[bytes]:
        """Ids of any words: encoded together, with a special token between them, as single calls cost more."""
        mark = self.tokenizer.token_to_id(BETWEEN)
        if mark is None or any(BETWEEN in w for w in words):
            return [self._encode(w).tobytes() for w in words]
        ids = self._encode(f" {BETWEEN} ".join(words))
        return [part.tobytes() for part in np.split(ids[ids != mark], np.flatnonzero(ids == mark) - np.arange(len(words) - 1))]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone: each has one token that ends a word, and its tokens have its bytes.

        Where one of the words has not, all are encoded with marks between them.
        """
        ids = self._encode(" ".join(words))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._marked(words)
        held = np.add.reduceat(self.sizes[ids], np.append(0, stops[:-1]))
        if held.tolist() != [len(self._normal(word).encode()) for word in words]:
            return self._marked(words)
        raw, stops = ids.tobytes(), (4 * stops).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def _learn(self, parts: set[str], encode) -> None:
        new = list(parts.difference(self.parts))
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            self.parts.update(zip(some, encode(some)))

    def learn(self, words: set[bytes]) -> None:
        """Each word is a head of letters, maybe empty, and a tail."""
        texts = b"\n".join(words).decode().split("\n")
        heads = [""] * len(texts)
        if self.ends is not None:
            cores = [text.rstrip(punctuation) for text in texts]
            # İ, for one, becomes a letter and a mark that the tokenizer joins to what follows.
            heads = [core if core.isalpha() and (core.isascii() or self._normal(core).isalpha()) else "" for core in cores]
        tails = [text[len(head):] for text, head in zip(texts, heads)]
        if self.lowers:
            heads = [head.lower() if head.isascii() else head for head in heads]
        self._learn(set(heads), self._letters)
        self._learn(set(tails), self._marked)
        ids = self.parts.__getitem__
        self.known.update(zip(words, map(add, map(ids, heads), map(ids, tails))))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        split = [text.split() for text in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                self.parts = {"": b""}
                new = set().union(*split)
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def token_ids(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text; about ``TOGETHER`` bytes of texts are split at once."""
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield from _tokenizers[path].ids(held)
            held, size = [], 0
    yield from _tokenizers[path].ids(held)


def cut(docs: DataFrame, id_col: str, text_col: str, path: str, row_id: str | None, sequence: int) -> DataFrame:
    """Pieces (piece, rid, id, start, length, doc_tokens, ids_crc32, ids) of at most ``sequence`` tokens."""
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    kind = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                      ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            out = []
            for row, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), token_ids(texts, path)):
                ids += end
                for at in range(0, len(ids), 4 * sequence):
                    part = ids[at:at + 4 * sequence]
                    out.append((row, doc, at // 4, len(part) // 4, len(ids) // 4, zlib.crc32(part), part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)] if out else
                                             [pa.array([], f.type) for f in kind], schema=kind)

    spec = "rid long, id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
    return numbered(rows.mapInArrow(pieces, spec), "packing-pieces", "piece")[0]


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the most valuable pattern of sizes that fits in ``room``."""
    worth, last = np.zeros(room + 1), np.full(room + 1, -1)
    good = values > 1e-12
    at, v = sizes[good], values[good]
    index = np.flatnonzero(good)
    for c in range(1, room + 1):
        worth[c], last[c] = worth[c - 1], -1
        n = np.searchsorted(at, c, side="right")
        if n:
            gains = worth[c - at[:n]] + v[:n]
            best = int(gains.argmax())
            if gains[best] > worth[c] + 1e-12:
                worth[c], last[c] = gains[best], index[best]
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] >= 0:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
        else:
            c -= 1
    return float(worth[room]), pattern


def greedy_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """One pattern a size and its use, filled from the largest size that is left.

    A pattern is used until it has used up a size, which no later pattern holds: the patterns are independent.
    """
    left, m = demand.copy(), len(sizes)
    columns, use, done = np.zeros((m, m)), np.zeros(m), np.zeros(m, bool)
    for turn in range(m):
        pattern, rest = columns[:, turn], room
        for at in np.flatnonzero(~done)[::-1]:
            if sizes[at] <= rest:
                pattern[at] = min(rest // sizes[at], max(1, int(left[at])))
                rest -= sizes[at] * pattern[at]
        held = np.flatnonzero(pattern)
        times = left[held] / pattern[held]
        used_up = held[times.argmin()]
        use[turn] = times.min()
        left = np.maximum(left - use[turn] * pattern, 0)
        left[used_up], done[used_up] = 0, True
    return columns, use


def solved(basis: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Inverse of the basis and the uses that meet the demand; None if they don't within a millionth."""
    try:
        inverse = np.linalg.inv(basis)
    except np.linalg.LinAlgError:
        return None
    use = inverse @ demand
    slack = 1e-6 * max(1.0, float(demand.max()))
    if not np.isfinite(inverse).all() or use.min() < -slack or np.abs(basis @ np.maximum(use, 0) - demand).max() > slack:
        return None
    return inverse, np.maximum(use, 0)


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 20_000,
                      refactor: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often each is used: the linear program of the cutting-stock problem.

    Starts with the greedy patterns. Each round prices a new pattern by the duals and swaps it into the
    basis, for the pattern with the largest pivot among those used up first; every ``refactor`` rounds the basis is inverted
    anew and has to meet the demand. Demands are raised by less than a millionth, each by another share, so that no two
    patterns are used up at once and the basis cannot go round in a circle. Ends when no pattern is worth more than a sequence, when every sequence is full (no plan
    uses fewer), when a basis is no longer sound, or after ``rounds``; the last sound patterns, never worse
    than the greedy ones, come back.
    """
    basis, use = greedy_patterns(sizes, demand, room)
    sound = basis.copy(), use
    raised = demand * (1 + 1e-7 * np.random.default_rng(len(sizes)).uniform(1, 2, len(sizes)))
    fresh = solved(basis, demand)
    full = float(sizes @ raised) / room
    for turn in range(rounds if fresh is not None else 0):
        if turn % refactor == 0:
            fresh, met = solved(basis, raised), solved(basis, demand)
            if fresh is None or met is None or met[1].sum() > sound[1].sum() * (1 + 1e-6):
                break
            inverse, use = fresh
            sound = basis.copy(), met[1]
        if use.sum() <= full * (1 + 1e-9):
            break
        worth, pattern = best_pattern(inverse.sum(axis=0), sizes, room)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ pattern
        able = step > 1e-7 * max(1.0, float(np.abs(step).max()))
        if not able.any():
            break
        ratio = np.where(able, use / np.where(able, step, 1), np.inf)
        tied = ratio <= ratio.min() * (1 + 1e-12)
        out = int(np.where(tied, step, 0).argmax())
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
    last = solved(basis, demand)
    if last is not None and last[1].sum() <= sound[1].sum():
        sound = basis, last[1]
    return sound[0].T.astype(np.int64), sound[1]


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: pieces}) that use up ``histogram`` (size: pieces) exactly.

    Patterns of the linear program, rounded down; what is left fits the fullest open sequence that takes it,
    largest first. A size that fills a sequence alone stands apart.
    """
    made = [(histogram[room], {room: 1})] if histogram.get(room) else []
    sizes = np.array(sorted(s for s in histogram if s < room), np.int64)
    if not len(sizes):
        return made
    demand = np.array([histogram[int(s)] for s in sizes], float)
    patterns, use = column_generation(sizes, demand, room)
    left = demand.astype(np.int64)
    for pattern, times in zip(patterns, use):
        kinds = pattern > 0
        times = min(int(times + 1e-6), int((left[kinds] // pattern[kinds]).min(initial=1 << 62))) if kinds.any() else 0
        if times > 0:
            left -= times * pattern
            made.append((times, {int(s): int(n) for s, n in zip(sizes[kinds], pattern[kinds])}))
    open_: dict[int, list[dict]] = {}
    for size, n in sorted(zip(sizes.tolist(), left.tolist()), reverse=True):
        for _ in range(n):
            free = min((f for f in open_ if f >= size), default=None)
            held = open_[free].pop() if free is not None else {}
            if free is not None and not open_[free]:
                del open_[free]
            held[size] = held.get(size, 0) + 1
            open_.setdefault((room if free is None else free) - size, []).append(held)
    return made + [(1, held) for group in open_.values() for held in group]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None,
         sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    A document is its token ids and then id 2, so null and empty texts are one token; pieces of ``sequence`` tokens
    are cut off its front. Lengths are rounded up to ``grain`` tokens for a histogram of ``sequence / grain``
    sizes at most; the driver plans with that histogram alone. Pieces of a size are ranked in a seeded order, and a rank
    falls into a pattern's places. Offsets in a sequence have no gaps, as real lengths add up. Rows that
    repeat an id are documents each; extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession, 256)
    spark, room = docs.sparkSession, sequence // grain
    pieces = cut(docs, id_col, text_col, path, row_id, sequence)
    sized = pieces.select("piece", "length", F.ceil(F.col("length") / grain).cast("int").alias("size"))
    histogram = {r["size"]: r["count"] for r in sized.groupBy("size").count().collect()}
    places, next_rank, first = [], dict.fromkeys(histogram, 0), 0
    for times, held in plan(histogram, room):
        for size, many in held.items():
            places.append((size, next_rank[size], next_rank[size] + times * many, many, first))
            next_rank[size] += times * many
        first += times
    spec = "size int, since long, until long, many long, first long"
    # As long as the patterns have sizes: it depends on room, not on the number of documents.
    table = F.broadcast(spark.createDataFrame(places, spec))
    numbered = ranked(sized, ["size"], ["piece"], "rank")
    placed = (numbered.join(table, "size").filter("rank >= since AND rank < until")
              .select("piece", "length", "size", (F.col("rank") - F.col("since")).alias("k"), "many", "first")
              .withColumn("sequence_id", F.col("first") + F.floor(F.col("k") / F.col("many"))))
    before = (Window.partitionBy("sequence_id").orderBy(F.desc("size"), F.col("k"))
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.select("piece", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return beside(pieces, "piece", offsets, "place").select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset", "ids")
