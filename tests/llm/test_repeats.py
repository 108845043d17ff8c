"""Repeated passages against brute force, and the merged transforms against a plain sort."""

import random

import numpy as np
import pandas as pd
import pytest

from premia.llm import repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, span):
    owners = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    for i, t in data:
        for a in range(len(t) - span + 1):
            s = t[a:a + span]
            owners[s] = min(owners.get(s, float("inf")), rank(i))
    out = []
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - span + 1):
            if owners[t[a:a + span]] < rank(i):
                gone[a:a + span] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(i), len(t), int(gone.sum()), edges, kept))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n, letters="abcdeé ": "".join(rng.choice(letters) for _ in range(n))
    shared = [line(rng.randint(49, 130)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [line(rng.choice([0, 3, 20, 200]))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), line(rng.choice([0, 1, 30]))]
        rows.append("".join(parts))
    rows += ["x" * 300, "x" * 60, "x" * 49, "xy" * 80, "yx" * 80, "", None, "\x00" * 70, "\x00" * 50 + "end", rows[0], rows[1] + "!", "é" * 25, "é" * 24 + "e"]
    rng.shuffle(rows)
    out = [(i * 2, t) for i, t in enumerate(rows)]
    return out + [(0, rows[5]), (6, rows[3]), (6, rows[3]), (None, rows[7]), (None, "only " + shared[0]), (-5, shared[1] + "z")]


@pytest.mark.parametrize("seed,block,bucket", [(1, 1 << 20, 1 << 20), (2, 700, 900), (3, 3000, 300)])
def test_against_brute_force(spark, monkeypatch, seed, block, bucket):
    rows = corpus(seed)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = repeats.remove_repeats(df, bucket_bytes=bucket).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute(rows, 50)
    assert all(r.n_removed == sum(s.length for s in r.spans) for r in got)


def test_edges(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(i, None, "en", "s", 0, 1) for i in range(3)], DOCS + ", block int")
    assert {(r.n_bytes, r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(df).collect()} == {(0, 0, b"")}


@pytest.mark.parametrize("seed", range(12))
def test_merge(seed):
    rng = random.Random(seed)
    shards = [[bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))] for _ in range(3)]
    made = [repeats.transform(s) for s in shards]
    texts = [t for s in shards for t in s]
    owners = [rng.randrange(4) for _ in texts]
    suffixes = [t[i:] for t in texts for i in range(len(t) + 1)]
    owner_of = np.array([o for t, o in zip(texts, owners) for _ in range(len(t) + 1)])
    at = np.concatenate([o + sum(len(m[1]) for m in made[:k]) for k, (_, o) in enumerate(made)])
    held = [(suffixes[x], owner_of[x]) for x in at]
    same = lambda a, b, depth: next((k for k in range(min(len(a), len(b), depth)) if a[k] != b[k]), min(len(a), len(b), depth))
    for depth in (1, 4, 12):
        order, group, common = repeats.merge([t for t, _ in made], owner_of[at], depth)
        assert common.tolist() == [max([same(a, b, depth) for b, p in held if p != o], default=0) for a, o in held]
        assert sorted(order.tolist()) == [x for x in range(len(held)) if common[x] == depth]
        first = [held[x][0][:depth] for x in order]
        assert first == sorted(first)
        assert all((a == b) == (g == h) for a, b, g, h in zip(first, first[1:], group, group[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_transform(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 9))] + [b"aa" * 30, b"aa" * 30]
    signs, order = repeats.transform(texts)
    whole = [([c + 1 for c in t[i:]] + [0], k, t[i - 1] + 1 if i else 0) for k, t in enumerate(texts) for i in range(len(t) + 1)]
    assert order.tolist() == sorted(range(len(whole)), key=lambda x: whole[x][:2])
    assert signs.tolist() == [whole[x][2] for x in order]


@pytest.mark.parametrize("seed,group", [(1, 150), (2, 2000), (3, 20_000)])
def test_small_groups_against_brute_force(spark, monkeypatch, seed, group):
    rows = corpus(seed)
    monkeypatch.setattr(repeats, "GROUP_BYTES", group, raising=False)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = repeats.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute(rows, 50)


@pytest.mark.parametrize("copies", [1, 2])
def test_a_frequent_passage_is_judged_in_bounded_parts(monkeypatch, copies):
    """All texts of a bucket lie under one hash, as around a line that very many documents have."""
    rng = random.Random(copies)
    line = bytes(rng.choice(b"abcdef") for _ in range(30))
    bits = [bytes(rng.choice(b"ghijkl") for _ in range(25)) + line for _ in range(2000 // copies)]
    texts = [b + bytes([rng.randrange(65, 90)]) * rng.randrange(1, 20) for b in bits for _ in range(copies)]
    owners = rng.sample(range(10_000), len(texts))
    rows = pd.DataFrame({"block": [7], "bucket": [3], "data": [b"".join(texts)], "ends": [np.cumsum([len(t) for t in texts]).tobytes()],
                         "least": [np.array(owners, np.int64).tobytes()], "keys": [np.full(len(texts), 9, np.uint64).tobytes()]})
    seen, merge = [], repeats.merge
    monkeypatch.setattr(repeats, "merge", lambda transforms, *rest: seen.append(sum(map(len, transforms))) or merge(transforms, *rest))
    monkeypatch.setattr(repeats, "GROUP_BYTES", 4096, raising=False)
    got = repeats._merge_bucket(rows, 50)
    least = {}
    for t, o in zip(texts, owners):
        for a in range(len(t) - 49):
            least[t[a:a + 50]] = min(least.get(t[a:a + 50], o), o)
    starts = np.array([a + 50 <= len(t) for t in texts for a in range(len(t) + 1)])  # the other bits are not read
    truth = [least[t[a:a + 50]] < o for t, o in zip(texts, owners) for a in range(len(t) - 49)]
    assert got["block"].tolist() == [7] and got["bucket"].tolist() == [3]
    assert np.unpackbits(np.frombuffer(got["bits"][0], np.uint8), count=len(starts)).astype(bool)[starts].tolist() == truth
    assert max(seen, default=0) <= 8 * 4096 < sum(map(len, texts))
