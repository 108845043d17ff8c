"""Repeated passages: merged Burrows-Wheeler transforms find byte strings that an earlier document has.

Documents are stored in blocks. In a block, every string of ``span`` bytes is filed under the smallest hash of
the k-byte strings in it, so equal strings of all documents are filed under the same hash. Strings whose
hash no other document has cannot be repeated. For the others each block hands its text pieces to the bucket of
the hash. A bucket cuts out the strings whose own hash two owners have, some pieces at a time, sorts them in shards,
merges the shards' Burrows-Wheeler transforms and returns one bit a string: whether a smaller document has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from premia.llm.common import stored, small_batches, text_of
from premia.llm.shingles import mix64

SPAN = 50
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 1 << 20
SHARD_BYTES = 64 << 10
#: A bucket looks at pieces of so many bytes at a time, and at so many bytes in all for each row of bits it makes at once.
GROUP_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    one = [np.uint64(1)]
    return tuple(np.multiply.accumulate(np.concatenate([one, np.full(size, b)])) for b in (_BASE, _BACK))


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of ``data``, which has one at least."""
    size = len(data)
    power, back = _powers(-(-size // BLOCK_BYTES) * BLOCK_BYTES)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:size])])
    return mix64((total[k:] - total[:-k]) * back[:size - k + 1])


def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ids, no_ids, ends, data): the documents of a block, their bytes laid end to end."""
    ids: list[int | None] = []
    texts: list[bytes] = []

    def row() -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([[LAST if i is None else i for i in ids]], pa.list_(pa.int64())),
            "no_ids": pa.array([[i is None for i in ids]], pa.list_(pa.bool_())),
            "ends": pa.array([ends], pa.list_(pa.int64())), "data": pa.array([b"".join(texts)], pa.binary())})

    size = 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= BLOCK_BYTES or len(ids) >= 100_000:
                yield row()
                ids, texts, size = [], [], 0
    if ids:
        yield row()


class Block:
    """A block's strings: ``keys`` is the filing hash of each start, ``runs`` cut the starts of a document by it."""

    def __init__(self, ids, ends, data: bytes, span: int):
        self.data = np.frombuffer(data, np.uint8)
        self.ids, self.ends, self.span = np.asarray(ids, np.int64), np.asarray(ends, np.int64), span
        begins = np.concatenate([[0], self.ends[:-1]])
        n = max(len(self.data) - span + 1, 0)
        keys = self._smallest(n)
        # Starts whose string would cross the end of their document are left out.
        change = np.zeros(n + 1, np.int32)
        stops = np.maximum(self.ends - span + 1, begins)
        has = stops > begins
        np.add.at(change, begins[has], 1)
        np.add.at(change, stops[has], -1)
        inside = np.cumsum(change[:n]) > 0
        edge = np.ones(n, bool)
        edge[1:] = (keys[1:] != keys[:-1]) | ~inside[:-1]
        edge[begins[has]] = True
        self.first = np.flatnonzero(edge & inside)
        following = np.flatnonzero(edge | ~inside)
        self.last = np.append(following, n)[np.searchsorted(following, self.first, side="right")]
        self.key = keys[self.first]
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def _smallest(self, n: int) -> np.ndarray:
        """The least hash of the k-byte strings inside the string at each start."""
        k = self.span // 2
        if not n:
            return np.zeros(0, np.uint64)
        least = _hashes(self.data, k)
        width, window = 1, self.span - k + 1
        while 2 * width <= window:
            least = np.minimum(least[:len(least) - width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[:len(least) - (window - width)], least[window - width:])
        return least[:n]

    def filed(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, sorted, and whether two documents of the block have them."""
        order = np.argsort(self.key, kind="stable")
        key, doc = self.key[order], self.ids[self.doc[order]]
        if not len(key):
            return key, np.zeros(0, bool)
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[at], np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)

    def pieces(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Runs filed under ``wanted`` as distinct texts: run indices, text of each run, texts, least id, hash."""
        found = np.searchsorted(wanted, self.key)
        found[found == len(wanted)] = 0
        runs = np.flatnonzero(wanted[found] == self.key) if len(wanted) else np.zeros(0, np.int64)
        known: dict[bytes, int] = {}
        raw = self.data.tobytes()
        texts = np.fromiter((known.setdefault(raw[a:b + self.span - 1], len(known)) for a, b in zip(self.first[runs].tolist(), self.last[runs].tolist())),
                            np.int64, len(runs))
        least, key = np.full(len(known), LAST), np.zeros(len(known), np.uint64)
        np.minimum.at(least, texts, self.ids[self.doc[runs]])
        key[texts] = self.key[runs]
        return runs, texts, list(known), least, key


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a set of texts, each with an end sign 0, and the sorted suffixes' places.

    Prefix doubling: suffixes get ranks by five signs, then by twice as many each time. The end sign of an earlier text
    is the smaller, so no two suffixes are equal and equal ones go by their text.
    """
    size = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + 1
    n = len(data)
    end = np.cumsum(size) - 1
    data[end] = 0
    left = np.repeat(end, size) - np.arange(n)
    depth, key = 5, data.copy()
    for j in range(1, depth):
        key = key * 257 + np.where(left[:n] >= j, np.append(data[j:], np.zeros(min(j, n), np.int64)), 0)
    key = key * (len(texts) + 1) + np.where(left < depth, np.repeat(np.arange(1, len(texts) + 1), size), 0)
    while True:
        order = np.argsort(key)
        fresh = np.append(True, np.diff(key[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            break
        key = rank * (n + 1) + np.append(rank[depth:], np.zeros(min(depth, n), np.int64))
        depth *= 2
    before = np.append(data[-1], data[:-1])
    return before[order].astype(np.uint16), order


def merge(transforms: list[np.ndarray], owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave sorted suffixes of several transforms by up to ``depth`` signs, as far as owners meet.

    ``owner`` is that of the text of each suffix, in the order of the transforms laid end to end; places count in
    that order. Returns the places of the suffixes whose first ``depth`` signs another owner has too, merged, the interval
    of equal signs that each lies in, and for every suffix the longest common prefix with a suffix of
    another owner (at most ``depth``, end signs left out). Each pass puts one more sign in front: suffixes in
    their order by t signs, dealt out by the sign before them, are in order by t + 1 signs. No text is read and no
    suffix is sorted again. An interval of one owner is settled: what stands before its suffixes parts into
    intervals of that owner only, so neither is dealt out again, nor is what goes beyond the begin of a text.
    """
    signs = np.concatenate(transforms)
    # Few signs occur: as bytes, in the same order, they are dealt out in one counting pass.
    has = np.bincount(signs, minlength=1) > 0
    has[0] = True
    code = np.cumsum(has) - 1
    signs = code[signs].astype(np.uint8 if code[-1] < 256 else np.uint16)
    place = np.int32 if len(signs) < 2**31 else np.int64
    step = np.empty(len(signs), place)
    at = 0
    for t in transforms:
        step[at + np.argsort(signs[at:at + len(t)], kind="stable")] = np.arange(at, at + len(t))
        at += len(t)
    order, group = np.arange(len(signs), dtype=place), np.zeros(len(signs), place)
    common = np.zeros(len(signs), np.int32)
    for t in range(1, depth + 1):
        sign = signs[order]
        dealt = np.argsort(sign, kind="stable")[len(sign) - np.count_nonzero(sign):]
        if not len(dealt):
            return order[:0], group[:0], common
        sign, source = sign[dealt], group[dealt]
        order = step[order[dealt]]
        at = np.flatnonzero(np.append(True, (sign[1:] != sign[:-1]) | (source[1:] != source[:-1])))
        held = owner[order]
        shared = np.minimum.reduceat(held, at) < np.maximum.reduceat(held, at)
        many = np.diff(np.append(at, len(order)))
        order = order[np.repeat(shared, many)]
        group = np.repeat(np.arange(np.count_nonzero(shared), dtype=place), many[shared])
        common[order] = t
    return order, group, common


def repeated(shards: list[tuple[np.ndarray, np.ndarray]], span: int) -> list[np.ndarray]:
    """For each shard (transform, owner of each suffix's text): whose first ``span`` signs a smaller owner has."""
    owner = np.concatenate([o for _, o in shards])
    order, group, _ = merge([t for t, _ in shards], owner, span)
    smaller = np.zeros(len(owner), bool)
    if len(order):
        held = owner[order]
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        smaller[order[np.minimum.reduceat(held, at)[group] < held]] = True
    return np.split(smaller, np.cumsum([len(t) for t, _ in shards])[:-1])


def _split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
    for part in np.split(order, at[1:]) if len(at) else []:
        yield int(bucket[part[0]]), part


def _shared_keys(held: pd.DataFrame) -> pd.DataFrame:
    """The hashes of each block in a bucket that two documents have, in one or in two blocks."""
    key = np.frombuffer(b"".join(held["keys"]), np.uint64)
    many = np.array([len(k) // 8 for k in held["keys"]])
    flag = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(held["many"], many)]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    n[at[np.concatenate(flag).astype(bool)]] = 2
    wanted = n[at] > 1
    ends = np.cumsum(many)
    out = [key[a:b][wanted[a:b]].tobytes() for a, b in zip((ends - many).tolist(), ends.tolist())]
    return pd.DataFrame({"block": held["block"].to_numpy(), "wanted": out})


def _shards(texts: list[bytes], least: int) -> Iterator[list[bytes]]:
    """``texts`` in their order, ``least`` bytes or a little more at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held


def _shared_strings(texts: list[bytes], owner: np.ndarray, span: int, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and offset, in order, of the strings of one part of all hashes whose hash two owners have."""
    found, at = [], 0
    for shard in _shards(texts, BLOCK_BYTES):
        size = np.array([len(t) for t in shard])
        key = _hashes(np.frombuffer(b"".join(shard), np.uint8), span)
        text = np.repeat(np.arange(len(shard), dtype=np.int32), size)[:len(key)]
        offset = (np.arange(len(key)) - (np.cumsum(size) - size)[text]).astype(np.int32)
        take = offset + span <= size[text]
        if parts > 1:
            take &= key % np.uint64(parts) == part
        found.append((key[take], text[take] + np.int32(at), offset[take]))
        at += len(shard)
    key, text, offset = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(key)
    begin = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else order
    if not len(begin):
        return key, text, offset
    held = owner[text[order]]
    meet = np.minimum.reduceat(held, begin) < np.maximum.reduceat(held, begin)
    kept = np.sort(order[np.repeat(meet, np.diff(np.append(begin, len(key))))])
    return key[kept], text[kept], offset[kept]


def _judged(texts: list[bytes], owner: np.ndarray, span: int, text: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For each string (text, offset), in order: whether one of the strings has it under a smaller owner.

    Strings that follow each other are one text again; a text that occurs twice is transformed once, with its least owner.
    """
    cut = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)))
    many = np.diff(np.append(cut, len(text)))
    known: dict[bytes, int] = {}
    at = np.fromiter((known.setdefault(texts[t][a:a + n + span - 1], len(known))
                      for t, a, n in zip(text[cut].tolist(), offset[cut].tolist(), many.tolist())), np.int64, len(cut))
    own, least = owner[text[cut]], np.full(len(known), LAST)
    np.minimum.at(least, at, own)
    size = np.array([len(t) + 1 for t in known])
    starts = np.cumsum(size) - size
    held = np.repeat(least, size)
    marks = np.zeros(len(held), bool)
    if len(known) > 1:
        done, made, orders = 0, [], []
        for shard in _shards(list(known), SHARD_BYTES):
            signs, order = transform(shard)
            orders.append(order + done)
            made.append((signs, held[orders[-1]]))
            done += len(order)
        marks[np.concatenate(orders)] = np.concatenate(repeated(made, span))
    return marks[np.repeat(starts[at] - cut, many) + np.arange(len(text))] | np.repeat(own > least[at], many)


def _repeated_strings(texts: list[bytes], owner: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, offset, whether a smaller owner has it) of the strings two owners may have, a bounded number at a time.

    Equal strings have equal hashes, so strings can be judged in parts by their hash, however many share a piece's.
    """
    parts = max(1, -(-sum(map(len, texts)) // GROUP_BYTES))
    for part in range(parts):
        key, text, offset = _shared_strings(texts, owner, span, part, parts)
        if not len(key):
            continue
        ends = np.count_nonzero((text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
        finer = -(-len(key) * span // GROUP_BYTES) if len(key) + ends * span > 4 * GROUP_BYTES else 1
        for i in range(finer):
            own = np.flatnonzero(key // np.uint64(parts) % np.uint64(finer) == i)
            if len(own):
                yield text[own], offset[own], _judged(texts, owner, span, text[own], offset[own])


def _merge_bucket(rows: pd.DataFrame, span: int) -> pd.DataFrame:
    """Bits of all strings that the blocks filed in one bucket.

    A text that several blocks filed is judged once, with the least owner of all; the others' strings are repeated
    throughout if their owner is larger. Equal strings have equal hashes, so only texts under a hash
    with two distinct texts and two owners are looked at, those of some hashes at a time.
    """
    known: dict[bytes, int] = {}
    many, at = [], []
    for data, ends in zip(rows["data"], rows["ends"]):
        stops = np.frombuffer(ends, np.int64).tolist()
        many.append(len(stops))
        at += [known.setdefault(data[a:b], len(known)) for a, b in zip([0, *stops], stops)]
    texts, at = list(known), np.array(at)
    del known
    own = np.frombuffer(b"".join(rows["least"]), np.int64)
    key = np.zeros(len(texts), np.uint64)
    key[at] = np.frombuffer(b"".join(rows["keys"]), np.uint64)
    first = np.full(len(texts), LAST)
    np.minimum.at(first, at, own)
    size = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(size) - size
    marks = np.zeros(int(size.sum()), bool)
    by_key = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(key[by_key]) != 0))
    meet = np.minimum.reduceat(first[by_key], begin) < np.maximum.reduceat(first[by_key], begin)
    bytes_ = np.add.reduceat(size[by_key], begin)
    held, load = [], 0

    def judge() -> None:
        group = np.concatenate(held)
        for text, offset, bit in _repeated_strings([texts[i] for i in group.tolist()], first[group], span):
            marks[starts[group[text]] + offset] = bit

    for a, b, n in zip(begin[meet].tolist(), np.append(begin[1:], len(key))[meet].tolist(), bytes_[meet].tolist()):
        if held and load + n > GROUP_BYTES:
            judge()
            held, load = [], 0
        held.append(by_key[a:b])
        load += n
    if held:
        judge()
    ends = np.cumsum(size[at])
    stop = np.cumsum(many)
    bits, row = [], 0
    while row < len(many):
        begins = int(stop[row]) - many[row]
        base = int(ends[begins] - size[at[begins]])
        to = max(row + 1, int(np.searchsorted(ends[stop - 1], base + GROUP_BYTES, side="right")))
        these = at[begins:stop[to - 1]]
        n = size[these]
        after = np.cumsum(n)
        bit = marks[np.repeat(starts[these] - (after - n), n) + np.arange(n.sum())] | np.repeat(own[begins:stop[to - 1]] > first[these], n)
        edge = (ends[stop[row:to] - 1] - base).tolist()
        bits += [np.packbits(bit[a:b]).tobytes() for a, b in zip([0, *edge], edge)]
        row = to
    return pd.DataFrame({"block": rows["block"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "bits": bits})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``spans`` (start, length) removed, ``kept`` bytes.

    A byte goes if a string of ``span`` bytes covers it that also starts in a document with a smaller id; all is judged
    on the input and no string crosses documents. Null and empty texts have no bytes. A null id is larger
    than all others; documents that share an id do not judge each other. Extra columns are ignored; an
    empty table gives no rows. A string that very many documents have is filed once for each block.
    """
    small_batches(docs.sparkSession, 256)
    # a block has 2 MB, so 256 of them are no small batch
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BLOCK_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(to_blocks, "ids array<long>, no_ids array<boolean>, ends array<long>, data binary")
                    .withColumn("block", F.monotonically_increasing_id()), "repeats-blocks")
    total = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row, Block(row["ids"], row["ends"], row["data"], span)

    def file_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in opened(batches):
            key, many = block.filed()
            out = [(b, row["block"], key[i].tobytes(), np.packbits(many[i]).tobytes())
                   for b, i in _split((key % np.uint64(buckets)).astype(np.int64), buckets)]
            if out:
                b, at, keys, flags = zip(*out)
                yield pa.RecordBatch.from_pydict({"bucket": b, "block": at, "keys": pa.array(keys, pa.binary()), "many": pa.array(flags, pa.binary())})

    filed = blocks.select("ids", "ends", "data", "block").mapInArrow(file_keys, "bucket long, block long, keys binary, many binary")
    shared = stored(filed.groupBy("bucket").applyInPandas(_shared_keys, "block long, wanted binary").filter("octet_length(wanted) > 0"), "repeats-keys")
    wanted = shared.groupBy("block").agg(F.collect_list("wanted").alias("wanted"))
    blocks = stored(blocks.join(wanted, "block", "left"), "repeats-wanted")

    def pieces_of(row: dict, block: Block):
        keys = np.sort(np.frombuffer(b"".join(row["wanted"] or []), np.uint64))
        runs, text, texts, least, key = block.pieces(keys)
        return runs, text, texts, least, key, list(_split((key % np.uint64(buckets)).astype(np.int64), buckets))

    def file_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in opened(batches):
            _, _, texts, least, key, parts = pieces_of(row, block)
            out = [(b, row["block"], b"".join(texts[j] for j in i), np.cumsum([len(texts[j]) for j in i], dtype=np.int64).tobytes(),
                    least[i].tobytes(), key[i].tobytes()) for b, i in parts]
            if out:
                b, at, data, ends, owner, keys = zip(*out)
                yield pa.RecordBatch.from_pydict({"bucket": b, "block": at, **{
                    n: pa.array(c, pa.binary()) for n, c in (("data", data), ("ends", ends), ("least", owner), ("keys", keys))}})

    filed = blocks.mapInArrow(file_pieces, "bucket long, block long, data binary, ends binary, least binary, keys binary")
    judged = stored(filed.groupBy("bucket").applyInPandas(lambda held: _merge_bucket(held, span), "block long, bucket long, bits binary"), "repeats-bits")
    bits = judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in opened(batches):
            runs, text, texts, least, _, parts = pieces_of(row, block)
            given = {x["bucket"]: x["bits"] for x in row["bits"] or []}
            size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
            begin = np.cumsum(size) - size
            marks = np.zeros(int(size.sum()), bool)
            for b, i in parts:
                n = size[i]
                spot = np.repeat(begin[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                marks[spot] = np.unpackbits(np.frombuffer(given[b], np.uint8), count=len(spot)).astype(bool)
            first, last = block.first[runs], block.last[runs]
            later = block.ids[block.doc[runs]] > least[text]
            n = last - first
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = marks[np.repeat(begin[text], n) + step] | np.repeat(later, n)
            starts = (np.repeat(first, n) + step)[hit]
            size = len(block.data) + 1
            cover = np.bincount(starts, minlength=size) - np.bincount(starts + span, minlength=size)
            yield from _cut_documents(row, block, np.cumsum(cover[:-1]) > 0)

    out = "id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary"
    return blocks.join(bits, "block", "left").mapInArrow(cut, out).withColumnRenamed("id", id_col)


def _cut_documents(row: dict, block: Block, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids, sizes, removed, spans, kept = [], [], [], [], []
    begin = 0
    for i, no_id, end in zip(row["ids"], row["no_ids"], block.ends.tolist()):
        mask = gone[begin:end]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        ids.append(None if no_id else i)
        sizes.append(end - begin)
        removed.append(int(mask.sum()))
        spans.append([{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
        kept.append(block.data[begin:end][~mask].tobytes())
        begin = end
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(kept, pa.binary())],
        names=["id", "n_bytes", "n_removed", "spans", "kept"])
