"""The filter audit, vector codes and quality votes against brute force on small and odd tables."""

import hashlib
import math
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.llm import filter_audit, quality, vector_codes
from premia.llm.text_tries import TextTrie, collapse, shared_bytes, smallest_ids, with_cells

DOCS = "doc_id long, text string, lang string, entry string, mask string, cell string, id string, part string"
LABELS = "doc_id long, quality int, toxic int, good string"


def documents(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x", "x", "x") for row in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame([(*row, "x") for row in rows], LABELS)


def odd_documents():
    family = "shared beginning of many texts " * 40
    rows = [(i, family + str(i % 37), "en" if i % 3 else None) for i in range(1, 150)]
    rows += [(200 + i, "one hot text " * 30, "de") for i in range(120)]
    rows += [(400, None, "en"), (401, "", "en"), (402, "", ""), (403, "   \t\n", ""), (None, "", "en"), (None, "lone", None)]
    rows += [(410, "ÄÖ ÜABC", "fr"), (411, "ÄÖ ÜABC", "fr"), (411, "ÄÖ ÜABC", "fr"), (410, "ÄÖ ÜABC", "fr")]
    rows += [(420, "price $5 | more", "fr"), (421, "a\x1cb c\xa0d", "fr"), (422, "AAA", "fr"), (423, "AAA", "fr")]
    rows += [(430, "long " + "word%d " * 3 % (1, 2, 3) + "z" * 300_000, "en"), (431, "long " + "word%d " * 3 % (1, 2, 3) + "z" * 299_999, "en")]
    rows += [(440 + i, " ".join(f"w{j}" for j in range(300)), "en") for i in range(3)]
    return rows


def failed(text, twin):
    words = text.encode().split()
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), twin]


def audited(docs, said):
    """What the audit has to say, row by row."""
    smallest, good, toxic = {}, set(), set()
    for key, text, _ in docs:
        if key is not None:
            smallest[text or ""] = min(smallest.get(text or "", key), key)
    for key, q, t in said:
        good |= {key} if q == 1 and key is not None else set()
        toxic |= {key} if t == 1 and key is not None else set()
    rows = [(part or "", failed(text or "", key is not None and key > smallest[text or ""]), key in good, key in toxic)
            for key, text, part in docs]
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                f = "ABCDE".index(name)
                hit = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                redundant = sum(r[1][f] for r in gone)
                gone += hit
                shapley[part, name] += len(hit)
                out[part, "".join(order), step] = [
                    len(left), len(hit), redundant, sum(r[1][f] and sum(r[1]) == 1 for r in rows if r[0] == part),
                    sum(r[2] for r in hit), sum(r[3] for r in hit)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("sizes", [{}, {"cell_bytes": 64, "range_bytes": 256, "local_bytes": 100}])
def test_filter_audit(spark, sizes):
    docs = odd_documents()
    said = [(i, i % 2, (i // 2) % 2) for i in range(0, 460, 3)] + [(9, None, None), (None, 1, 1), (12, 1, 0), (12, 0, 1), (12, 1, 0)]
    got = filter_audit.audit_filters(documents(spark, docs).repartition(3), labels(spark, said), **sizes).collect()
    want = audited(docs, said)
    assert len(got) == len(want) == 600 * len({d[2] or "" for d in docs})
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == want[r.part, r.filter_order, r.step], r


def test_filter_audit_of_empty_tables(spark):
    assert filter_audit.audit_filters(documents(spark, []), labels(spark, [])).count() == 0
    got = filter_audit.audit_filters(documents(spark, [(1, None, None)]), labels(spark, []))
    assert got.count() == 600 and {r.part for r in got.collect()} == {""}


def test_text_trie():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(2000)] + [b"", b"a" * 5000, b"a" * 4999]
    trie, counted = TextTrie(), Counter(texts)
    for text in texts:
        end = trie.terminal(text)
        end.held = (text, (end.held or (text, 0))[1] + 1)
    assert dict(trie.held()) == counted
    assert shared_bytes(b"abcd", b"xxabcx", 2) == 3 and shared_bytes(b"a", b"", 0) == 0


def test_cells_stay_below_the_limit(spark):
    texts = [f"start {'same ' * 30}{i} {'rest' * (i % 5)}".encode() for i in range(400)] + [b"q" * 900]
    cells = with_cells(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "entry long, text binary"), 500).collect()
    weight = Counter()
    for r in cells:
        assert r.text.startswith(r.cell)
        weight[bytes(r.cell)] += len(r.text)
    assert len(cells) == len(texts) and len({bytes(r.cell) for r in cells}) > 50
    assert all(w <= 500 or all(len(r.text) <= len(r.cell) * 4 for r in cells if r.cell == c) for c, w in weight.items())


def test_smallest_ids_are_those_of_whole_texts(spark):
    rows = spark.createDataFrame([(i, "p", (b"x" * 1000) + bytes([i % 7])) for i in range(300)], "id long, part string, text binary")
    entries = collapse(rows.repartition(4), lambda t: 0, 3000)
    found = entries.filter("text IS NULL").join(smallest_ids(entries, 500, 2000), "entry").collect()
    assert len(found) == 300 and all(r.smallest == r.id % 7 for r in found)


VECTORS = "vec_id long, embedding array<double>, label int, x string, width string, apart string, code string"


def vectors(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], VECTORS)


def coded(rows, entries=64, rounds=2, parts=16):
    """Vector codes by comparing every part with every entry, one width after the other."""
    def sound(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v)

    kept = [(i, [math.floor(max(-2.0**62, min(2.0**62, 256 * c))) for c in v], label) for i, v, label in rows if sound(v)]
    out = []
    for width in {len(x) for _, x, _ in kept}:
        mine = sorted((r for r in kept if len(r[1]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = [p * width // parts for p in range(parts + 1)]
        books = [[x[a:b] for _, x, _ in mine[:entries]] for a, b in zip(cuts, cuts[1:])]

        def assign():
            return [[min((sum((c - d) ** 2 for c, d in zip(x[a:b], e)), k) for k, e in enumerate(book))
                     for a, b, book in zip(cuts, cuts[1:], books)] for _, x, _ in mine]

        for _ in range(rounds):
            found = assign()
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                for k in range(len(books[p])):
                    used = [x[a:b] for (_, x, _), f in zip(mine, found) if f[p][1] == k]
                    if used:
                        books[p][k] = [sum(c) // len(used) for c in zip(*used)]
        digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
        for (i, _, label), f in zip(mine, assign()):
            out.append((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), label, digest))
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    top = (1 << 63) - 1
    return sorted(((i, code, min(e, top), min(total[label], top), digest) for i, code, e, label, digest in out), key=str)


def odd_vectors():
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.normal(size=32) / 4).round(3).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(180)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(60)] + [rows[0], rows[0], (None, rows[3][1], 2), (5, rows[7][1], None)]
    rows += [(1200, None, 1), (1201, [0.1, None] * 16, 1), (1202, [float("nan")] * 32, 1), (1203, [float("inf")] + [0.0] * 31, 1)]
    rows += [(1300 + i, rng.normal(size=20).round(2).tolist(), 4) for i in range(70)] + [(1400, [], 4), (1401, [0.5], None)]
    return rows


def result(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_vector_codes(spark):
    rows = odd_vectors()
    got = vector_codes.compress(vectors(spark, rows).repartition(5))
    assert result(got) == coded(rows)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vector_codes_of_extreme_and_few_vectors(spark):
    big = [(i, [(-1.0) ** i * 10.0 ** (i % 7 * 3) + i] * 16, 0) for i in range(30)] + [(40, [1e300] * 16, 0), (41, [-1e300] * 16, 1)]
    assert result(vector_codes.compress(vectors(spark, big))) == coded(big)
    ties = [(i, [float(i % 2)] * 16, None) for i in range(20)]
    assert result(vector_codes.compress(vectors(spark, ties))) == coded(ties)
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).count() == 0


def test_pivots_prune_without_changing_results():
    rng = np.random.default_rng(1)
    for width in (1, 4, 9):
        entries, x = rng.integers(-40, 40, (64, width)), rng.integers(-60, 60, (500, width))
        entries[9] = entries[30]
        pivots = vector_codes.far_apart(entries, 3)
        best, error = vector_codes.nearest(x, vector_codes.pivot_distances(x, pivots), entries, pivots)
        all_pairs = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == all_pairs.argmin(axis=1)).all() and (error == all_pairs.min(axis=1)).all()


def quality_tables(spark, n=400):
    good = "Some plain words stand here, and other words follow in line {i}. They end well {j}."
    bad = "Some*** $$$ words### || stand%%% &&& {i} {i} {i} ***"
    docs = [(i, (good if i % 4 else bad).format(i=i, j=i * 7) * (1 + i % 9), "en") for i in range(n)]
    said = [(i, int(i % 4 > 0), 0) for i in range(0, n, 2)]
    docs += [(n, "", "en"), (n + 1, None, None), (n + 2, "\n \n", None), (None, bad, "en"), (3, docs[3][1], "en"), (n + 3, "x" * 2_500_000, "en")]
    return documents(spark, docs), labels(spark, said + [(None, 1, 0), (4, None, 0), (10**9, 0, 0), (8, 0, 0), (8, 1, 0)])


def test_quality_votes(spark):
    docs, said = quality_tables(spark)
    got = quality.judge_quality(docs.repartition(3), said).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 4 > 0), r
    again = quality.judge_quality(docs.repartition(7), said).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quality_scores_are_those_of_the_nearest(spark):
    docs, said = quality_tables(spark, 120)
    space = quality.learn(docs, said, "doc_id", "text", "quality", F.lit(True), per_label=20)
    assert len(space.good) == 40 and space.stands.max() > 1
    texts = [b"", b"Plain words.", b"*** $$$ ### words", b"a\nb\na\nb", "Ünd Ärger".encode()] * 60
    placed = space.place(texts)
    for t, v, score in zip(texts, placed, space.scores(texts, block=7)):
        near = [round(float(v @ w), 9) for w in space.vectors]
        best = sorted(range(len(near)), key=lambda i: (-near[i], i))[:quality.NEIGHBOURS]
        vote = [max(near[i], 0) ** quality.SHARPNESS * space.stands[i] for i in best]
        want = sum(w * space.good[i] for w, i in zip(vote, best)) / sum(vote)
        assert abs(score - want) < 1e-5, t


def test_quality_of_empty_tables(spark):
    docs, said = quality_tables(spark, 20)
    assert quality.judge_quality(documents(spark, []), said).count() == 0
    assert {(r.score, r.predicted) for r in quality.judge_quality(docs, labels(spark, [])).collect()} == {(0.5, 0)}
    only = quality.judge_quality(docs, labels(spark, [(1, 1, 0), (4, 1, 0), (5, 1, 0)])).collect()
    assert {r.score for r in only} == {1.0}


def test_quality_terms_do_not_depend_on_the_cut(monkeypatch):
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 7, 64, 65, 1000):
        text = bytes(rng.choice(np.frombuffer(b"abAB12  \n#$", np.uint8), size))
        whole = quality.shape_terms(text)
        for chunk in (1, 3, 64):
            monkeypatch.setattr(quality, "CHUNK", chunk)
            assert (quality.shape_terms(text) == whole).all(), (size, chunk)
            monkeypatch.undo()


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, said = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge_quality(docs, said).filter("held_out").join(said, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in got)
    assert len(got) > 50 and right / len(got) >= 0.95
