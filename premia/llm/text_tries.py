"""Compressed radix tries over whole texts, built over ranges of adaptive prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from premia.llm.common import stored

FIRST_PREFIX = 8
CELL_BYTES = 32 << 20
RANGE_BYTES = 64 << 20
LOCAL_BYTES = 32 << 20
#: Heavy prefixes are broadcast up to this many rows of eight bytes; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


class Node:
    """A branch: the bytes on its edge, its branches by their first byte, and what a text that ends here holds."""

    __slots__ = ("edge", "branches", "held")

    def __init__(self, edge: bytes):
        self.edge, self.branches, self.held = edge, {}, None


def shared_bytes(edge: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``edge`` the text has from ``at`` on."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == text[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class TextTrie:
    """Whole byte strings; the terminal of each holds what the caller puts there."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def terminal(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made if it is not there."""
        node, at = self.root, 0
        while at < len(text):
            branch = node.branches.get(text[at])
            if branch is None:
                branch = node.branches[text[at]] = Node(text[at:])
                self.size += len(text) - at
                return branch
            if not text.startswith(branch.edge, at):
                same = shared_bytes(branch.edge, text, at)
                fork = Node(branch.edge[:same])
                node.branches[text[at]] = fork
                branch.edge = branch.edge[same:]
                fork.branches[branch.edge[0]] = branch
                branch = fork
            node, at = branch, at + len(branch.edge)
        return node

    def held(self) -> Iterator:
        """What the terminals hold."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.held is not None:
                yield node.held
            todo.extend(node.branches.values())


def smaller(a, b):
    """The smaller of two ids; null is no id."""
    return b if a is None else a if b is None or a <= b else b


def in_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weight, most: int = 4 << 20,
               many: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about ``most`` weight and at most ``many`` rows."""
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += weight(row)
        if heavy > most or len(held) >= many:
            yield _batch(held, names, types)
            held, heavy = [], 0
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def collapse(rows: DataFrame, judge, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """One stored table of two kinds of rows, made in one pass over (id, part, text as binary).

    Each task puts its texts into a trie and gives every different text one ``entry``: a row with the text and the
    smallest id it saw (``least``). A row without text stands for each document: entry, id, part and
    ``mask``, what ``judge`` says of its text. A trie above ``local_bytes`` is handed on and begun anew.
    """
    id_type = rows.schema["id"].dataType

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, number = TextTrie(), TaskContext.get().partitionId() << 33
        names, types = ["entry", "text", "least", "id", "part", "mask"], None

        def texts() -> Iterator[pa.RecordBatch]:
            return in_batches(((h[0], h[1], h[2], None, None, None) for h in trie.held()), names, types, lambda r: len(r[1]))

        for batch in batches:
            if types is None:
                own = batch.schema.field("id").type
                types = [pa.int64(), pa.binary(), own, own, pa.string(), pa.int32()]
            documents = []
            for key, part, text in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "text"))):
                end = trie.terminal(text)
                if end.held is None:
                    end.held = [number, text, key, judge(text)]
                    number += 1
                else:
                    end.held[2] = smaller(end.held[2], key)
                documents.append((end.held[0], None, None, key, part, end.held[3]))
            yield _batch(documents, names, types)
            if trie.size > local_bytes:
                yield from texts()
                trie = TextTrie()
        if types is not None:
            yield from texts()

    kind = id_type.simpleString()
    return stored(rows.select("id", "part", "text").mapInArrow(
        combine, f"entry long, text binary, least {kind}, id {kind}, part string, mask int"), "trie-entries")


def with_cells(texts: DataFrame, limit: int, first: int = FIRST_PREFIX) -> DataFrame:
    """Add ``cell``: the shortest prefix, of 8, 32, 128 … bytes, whose texts have at most ``limit`` bytes together.

    Only the texts of a prefix that is too heavy get a longer one. Equal texts have equal cells. A cell
    stays heavier only if no text in it is longer than the prefix. A heavy prefix is known by its hash; were two
    to share one, a cell would be cut finer than it has to be.
    """
    length = first
    celled = texts.withColumn("cell", F.substring("text", 1, length))
    deepened = celled
    while True:
        heavy = stored(deepened.groupBy("cell").agg(F.sum(F.octet_length("text")).alias("bytes"),
                                                    F.max(F.octet_length("text")).alias("longest"))
                       .filter((F.col("bytes") > limit) & (F.col("longest") > length))
                       .select(F.xxhash64("cell").alias("heavy")).distinct(), "heavy-prefixes")
        many = heavy.count()
        if not many:
            return celled
        if many <= BROADCAST_ROWS:
            heavy = F.broadcast(heavy)
        length *= 4
        marked = celled.join(heavy, F.xxhash64("cell") == F.col("heavy"), "left")
        celled = marked.withColumn("cell", F.when(F.col("heavy").isNull(), F.col("cell")).otherwise(
            F.substring("text", 1, length)))
        deepened, celled = celled.filter("heavy IS NOT NULL").drop("heavy"), celled.drop("heavy")


def smallest_ids(entries: DataFrame, cell_bytes: int = CELL_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(entry, smallest): for each entry of ``collapse`` the smallest id that has its text, over all tasks.

    Texts are range-partitioned by their cells. Each task sorts its texts by cell and puts the whole texts of one
    cell after the other into a trie, whose terminals hold the smallest id and the entries; the trie goes as soon as
    its cell ends. A cell weighs a quarter of a range's fair share at most, and never above ``cell_bytes``
    unless one text does.
    """
    spark = entries.sparkSession
    texts = entries.filter("text IS NOT NULL").select("entry", "text", "least")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    limit = min(cell_bytes, max(1 << 14, total // (4 * ranges)))
    kind = entries.schema["least"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now, id_type = TextTrie(), None, None

        def settled() -> Iterator[pa.RecordBatch]:
            rows = ((entry, least) for least, keys in trie.held() for entry in keys)
            return in_batches(rows, ["entry", "smallest"], [pa.int64(), id_type], lambda r: 16)

        for batch in batches:
            id_type = batch.schema.field("least").type
            for entry, text, least, cell in zip(*(batch.column(c).to_pylist() for c in ("entry", "text", "least", "cell"))):
                if cell != now:
                    yield from settled()
                    trie, now = TextTrie(), cell
                end = trie.terminal(text)
                if end.held is None:
                    end.held = [least, [entry]]
                else:
                    end.held[0] = smaller(end.held[0], least)
                    end.held[1].append(entry)
        yield from settled()

    return (with_cells(texts, limit).repartitionByRange(ranges, "cell").sortWithinPartitions("cell")
            .mapInArrow(merge, f"entry long, smallest {kind}"))
