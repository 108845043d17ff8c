"""Distinct word shingles of whole texts as 64-bit hashes, computed with whole-array steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(SLICE, np.uint64(_BASE))]))
_INVERSES = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(SLICE, np.uint64(pow(_BASE, -1, 1 << 64)))]))


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _words(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of a slice and their hashes; A-Z count as a-z."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    powers, inverses = _POWERS, _INVERSES
    if len(data) > SLICE:  # one word longer than a slice
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), powers[1])]))
        inverses = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(data), inverses[1])]))
    summed = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[:len(data)])])
    value = (summed[stop] - summed[start]) * inverses[start]
    return start, mix64(value ^ ((stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _slices(data: np.ndarray, blank: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of at most ``SLICE`` bytes that end at blanks; longer only where a word is."""
    at = 0
    while at < len(data):
        stop = min(at + SLICE, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(blank[at:stop])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(blank[stop:])
                stop = stop + int(more[0]) + 1 if len(more) else len(data)
        yield at, stop
        at = stop


def _shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of one text's word hashes; with too few words, the whole sequence is one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(WORDS, len(words))
    h = np.full(len(words) - width + 1, np.uint64(width * 0x632BE59BD9B4E019 & _MASK))
    for j in range(width):
        h = mix64(h + words[j:len(words) - width + 1 + j])
    return np.unique(h)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; empty for null or without words."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append(text or b"")
        size += len(group[-1]) + 1
        if size >= SLICE:
            yield from _group(group)
            group, size = [], 0
    yield from _group(group)


def _group(group: list[bytes]) -> Iterator[np.ndarray]:
    if not group:
        return
    data = np.frombuffer(b"\n".join(group), np.uint8)
    blank = _blank(data)
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, stop in _slices(data, blank):
        s, h = _words(data[at:stop], blank[at:stop])
        starts.append(s + at)
        hashes.append(h)
    starts, hashes = np.concatenate(starts), np.concatenate(hashes)
    ends = np.cumsum([len(t) + 1 for t in group])
    last = 0
    for upto in np.searchsorted(starts, ends):
        yield _shingles(hashes[last:upto])
        last = upto


def binaries(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()
