"""Exact dedup, URL rules, top-k search, mixing and sharding against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from premia.llm import common, exact_dedup, jaccard_join, max_score, mixing, packing, sharding, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 30, 400]))), "en", rng.choice(["a", "b", "é", None]), 1)
            for i in range(300)]
    rows += [(i, "one  hot\ttext", "en", "a", 1) for i in range(300, 500)]
    rows += [(500, "one hot text", "en", "b", 1), (501, None, None, None, None), (502, "", "x", "b", 0), (503, " ", "x", "b", 0),
             (None, "one hot text", "en", "b", 1), (7, "one hot text", "en", "b", 1), (7, "one hot text", "en", "b", 1)]
    return rows


def test_exact_dedup(spark, corpus):
    got = exact_dedup.exact_dedup(docs_of(spark, corpus), frequent=3, tracked=64).collect()
    groups = defaultdict(list)
    for i, text, *_ in corpus:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(i)
    assert len(got) == len(corpus)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert {k: sorted(map(str, v)) for k, v in groups.items()} == {k: sorted(str(r.doc_id) for r in v) for k, v in by.items()}
    for key, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in by[key]} == {first} and {r.group_size for r in by[key]} == {len(ids)}
        assert [r.doc_id for r in by[key] if r.kept] == [first]


def test_exact_dedup_edges(spark, corpus):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0
    odd = docs_of(spark, [(*r, 1, 2) for r in corpus], ", row_id int, digest int")
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in corpus})
    every_same = docs_of(spark, [(5, "x", "en", "s", 1)] * 40)
    assert exact_dedup.drop_copies(every_same).count() == 1


def test_exact_dedup_is_native(spark, corpus):
    plan = exact_dedup.exact_dedup(docs_of(spark, corpus))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan


URLS = ["https://a.com/x", "https://WWW.example.com/en/1?q=1", "http://example.com/en/2", "http://blog.example.com/en/3",
        "http://x.net/es/1", "http://x.net/fr/1#top", "http://x.net/de/1", "https://x.org/fr/9", None, "no scheme", "", "http://",
        "http://com/", "http://acom/", "http://com", "https://xexample.com/en/", "a://b://c/d"]


def listed_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_rules.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return host, path, max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_rules.filter_urls(pages).collect()}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate(URLS * 2):
        host, path, rule = listed_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0] + rule[1])
        assert got[i].verdict == (rule[2] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert url_rules.filter_urls(pages.limit(0)).count() == 0
    unlabelled = pages.filter("url IS NULL OR url = ''")
    assert {r.verdict for r in url_rules.filter_urls(unlabelled).collect()} == {"allow"}


def test_mined_rules(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        items = sorted(rng.sample("abcdef", rng.randint(0, 5)))
        rows.append((items, "block" if ("a" in items and "b" in items) != (rng.random() < 0.1) else "allow"))
    support, sure = 0.05, 0.6
    counts, hits = Counter(), Counter()
    for items, verdict in rows:
        for n in range(1, len(items) + 1):
            for part in itertools.combinations(items, n):
                counts[part] += 1
                hits[part, verdict] += 1
    rules = {(p, v): (hits[p, v] / counts[p], hits[p, v]) for (p, v) in hits
             if hits[p, v] >= support * len(rows) and hits[p, v] / counts[p] >= sure}
    lean = {(p, v): r for (p, v), r in rules.items()
            if not any(rules.get((p[:i] + p[i + 1:], v), (0,))[0] >= r[0] for i in range(len(p)))}
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), support, sure)
    assert {(tuple(r.tokens), r.verdict): round(r.confidence, 9) for r in mined.collect()} == {
        k: round(v[0], 9) for k, v in lean.items()}
    asked = [sorted(rng.sample("abcdef", n)) for n in (0, 1, 2, 3, 4, 5, 6)]
    got = {tuple(r.tokens): r.learned for r in url_rules.match(
        spark.createDataFrame([(a,) for a in asked], "tokens array<string>"), mined).collect()}
    for a in asked:
        fits = [(-c, -n, len(p), list(p), v) for (p, v), (c, n) in lean.items() if set(p) <= set(a)]
        assert got.get(tuple(a)) == (min(fits)[-1] if fits else None)


def test_deep_addresses(spark):
    rng = random.Random(8)
    rows, deep = [], "/".join(f"w{k}x" for k in "abcdefghijklmnopqrstuvwxyz")
    for i in range(400):
        verdict = "block" if i % 2 else "allow"
        end = "shop" if i % 2 else "docs"
        rows.append((i, f"https://{end}.d.c.b.a.example.com/en/p/{deep}/{rng.choice('xyz')}", verdict))
        rows.append((1000 + i, f"https://s.d.c.b.a.example.net/{rng.choice('pq')}/p/q/r/{end}/{i}", verdict))
    asked = [(5000, "https://shop.z.y.x.w.example.org/a/b/c"), (5001, "https://docs.z.y.x.w.example.org/a/b/c"),
             (5002, "https://h.example.org/p/q/r/s/t/shop/1"), (5003, "https://h.example.org/p/q/r/s/t/docs/1"),
             (5004, "https://shop.example.org/a"), (5005, "https://h.example.org/a/shop")]
    url = F.col("url")
    with_tokens = lambda df: df.withColumn("tokens", url_rules.tokens(url, url_rules.host_of(url), url_rules.path_of(url)))
    examples = with_tokens(spark.createDataFrame(rows, "page_id long, url string, verdict string"))
    pages = with_tokens(spark.createDataFrame(asked, "page_id long, url string"))
    tokens = {r.page_id: set(r.tokens) for r in pages.collect()}
    assert {"host0:org", "host3:x", "host:z", "host:shop", "path0:a", "path:c"} <= tokens[5000]
    assert {"path0:p", "path:shop", "path:0"} <= tokens[5002] and "path1:shop" in tokens[5005]
    learned = url_rules.match(pages, url_rules.mine(examples.select("tokens", "verdict")))
    got = {r.page_id: r.learned for r in pages.join(learned, "tokens").collect()}
    assert [got.get(k) for k in (5000, 5001, 5002, 5003)] == ["block", "allow", "block", "allow"]


def test_tokens_of_the_same_examples(spark):
    rows = [(["a", "b", "c"] if i % 2 else ["d"], "block" if i % 2 else "allow") for i in range(40)]
    mined = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    assert sorted((r.tokens, r.verdict) for r in mined.collect()) == [(["a"], "block"), (["b"], "block"), (["c"], "block"), (["d"], "allow")]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_top(rows, k=5, scale=256):
    ints = [(i, [__import__("math").floor(scale * c) for c in x]) for i, x, _ in rows
            if i is not None and x is not None and all(c is not None and c == c and abs(c) != float("inf") for c in x)]
    out = set()
    for i, q in ints:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in ints if j != i and len(x) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("shard", [7, 4096])
def test_top_k(spark, shard):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) if rng.random() < 0.4 else 0.0 for _ in range(8)], 0) for i in range(240)]
    rows = [(i, __import__("numpy").array(x, "float32").tolist(), 0) for i, x, _ in rows]
    rows += [(j + 240, rows[50][1], 0) for j in range(20)]
    rows += [(300, None, 0), (301, [1.0, None] + [0.0] * 6, 0), (302, [float("nan")] + [0.0] * 7, 0), (303, [float("inf")] * 8, 0),
             (350, [1.0, 2.0], 0), (351, [3.0, 4.0], 0), (400, [], 0), (None, [0.0] * 8, 0)]
    v = max_score.integer_vectors(vectors_of(spark, rows), "vec_id", "embedding", 256)
    got = max_score.top_k(v.filter("id % 50 = 0"), v, 5, shard_rows=shard, query_rows=3).collect()
    assert {tuple(r) for r in got} == brute_top(rows) and len(got) == len(brute_top(rows))
    assert max_score.top_k(v.limit(0), v, 5).count() == 0 and max_score.top_k(v, v.limit(0), 5).count() == 0


def test_top_k_large_values(spark):
    rows = [(0, [3e9, 1e9], 0), (1, [2e9, 5.0], 0), (2, [-3e9, 1.0], 0), (3, [3e9, 3e9], 0)]
    v = max_score.integer_vectors(vectors_of(spark, rows), "vec_id", "embedding", 256)
    got = [r.vec_id for r in max_score.top_k(v.filter("id = 0"), v, 2).orderBy("rank").collect()]
    assert got == [1, 3] or got == [3, 1]


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
    return out


@pytest.mark.parametrize("shard", [20, 1024])
def test_mix(spark, corpus, shard):
    got = mixing.mix(docs_of(spark, corpus), shard_rows=shard, block_words=32).collect()
    again = mixing.mix(docs_of(spark, corpus).repartition(5), shard_rows=shard, block_words=32).collect()
    strip = lambda rows: Counter((r.doc_id, r["size"], r.taken) for r in rows)
    assert strip(got) == strip(again) and len(got) == len(corpus)
    sizes = Counter({s: 0 for *_, s, _ in corpus})
    source = {}
    for i, text, _, s, _ in corpus:
        sizes[s] += len((text or "").split())
        source[i] = s
    goal = brute_targets(sizes)
    taken = Counter()
    for r in got:
        s = source[r.doc_id] if r.doc_id != 7 else None
        assert 0 <= r.taken <= 3 * r["size"]
        if s is not None or r.doc_id == 501:
            assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6
        taken[round(r.target, 6)] += r.taken
    for s, t in goal.items():
        alike = [x for x in goal if round(goal[x], 6) == round(t, 6)]
        assert abs(taken[round(t, 6)] - sum(goal[x] for x in alike)) <= 32 * (1 + len(alike)), s


@pytest.mark.parametrize("weights", [(5, 2, 1), (80000, 1800, 30), (40000, 5000, 3)])
def test_mix_meets_targets(spark, weights):
    rows = [(s, " ".join(f"w{k}" for k in range(n)), m) for s, n, m in (("a", 40, 2000), ("b", 30, 60), ("c", 10, 3)) for _ in range(m)]
    df = docs_of(spark, [(i, f"{t} {i}"[3:] if i % 2 else t, "en", s, 1) for i, (s, t, _) in enumerate(rows)])
    got = mixing.mix(df, shard_rows=20, weights=weights).collect()
    taken, goal = Counter(), {}
    for r in got:
        s = rows[r.doc_id][0]
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == len(rows[r.doc_id][1].split())
        taken[s] += r.taken
        goal[s] = r.target
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal), (taken, goal)
    assert sum(taken.values()) == 2000 * 40 + 60 * 30 + 3 * 10


def test_sainte_lague(spark):
    rng = random.Random(5)
    for n, seats in ((1, 4), (3, 0), (4, 7), (9, 1), (12, 1000), (7, 3)):
        votes = [rng.choice([0, 1, 5, 5, 40, 1000 * rng.random()]) for _ in range(n)]
        df = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "p int, votes double, seats long")
        got = {r.p: r.quota for r in mixing.sainte_lague(df, [], ["p"]).collect()}
        quotients = sorted(((-v / (2 * i - 1), p) for p, v in enumerate(votes) if v > 0 for i in range(1, seats + 1)))[:seats]
        assert got == {p: Counter(q[1] for q in quotients)[p] for p in range(n)}


def test_mixed_rows(spark):
    rows = [(i, f"a{i}  b\nc d e", "en", "s" + str(i % 4), 1) for i in range(40)] + [(99, None, "en", "s0", 0)] + [(1, "x y z", "en", "s1", 1)] * 3
    odd = docs_of(spark, [(*r, i) for i, r in enumerate(rows)], ", mix int")
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    total = sum(len((r[1] or "").split()) for r in rows)
    assert abs(sum(len(r.text.split()) for r in out.collect()) - total) <= 2 * 256
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_shards(spark, corpus):
    got = sharding.shard_documents(docs_of(spark, corpus), rounds=3).collect()
    texts = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in corpus)
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in got) == texts
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(8)) and {len(v) for v in by.values()} <= {len(corpus) // 8, len(corpus) // 8 + 1}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_documents(docs_of(spark, [])).count() == 0


def test_shards_keep_groups(spark):
    rows = [(i, f"text {i // 3}", "en", "s", 1) for i in range(600)] + [(600 + i, f"single {i}", "en", "s", 1) for i in range(600)]
    got = sharding.shard_documents(docs_of(spark, rows)).collect()
    where = {r.doc_id: r.shard for r in got}
    apart = sum(len({where[3 * g + j] for j in range(3)}) > 1 for g in range(200))
    assert apart <= 10
    pairs = spark.createDataFrame([(i, i // 2) for i in range(600, 1200)], "doc_id long, link long")
    got = sharding.shard_documents(docs_of(spark, rows), links=pairs).collect()
    where = {r.doc_id: r.shard for r in got}
    assert sum(where[i] != where[i + 1] for i in range(600, 1200, 2)) <= 15


@pytest.mark.parametrize("whole", [1, 10**9])
def test_shards_settle_hot_group(spark, monkeypatch, whole):
    monkeypatch.setattr(sharding, "WHOLE", whole, raising=False)
    rows = [(i, "hot" if i < 1600 else f"text {i // 2}" if i < 2400 else f"single {i}", "en", "s", 1) for i in range(4800)]
    got = sharding.shard_documents(docs_of(spark, rows)).collect()
    where = {r.doc_id: r.shard for r in got}
    assert set(Counter(where.values()).values()) == {600}
    # The hot group needs three shards of 600; united pairs may hold part of them.
    hot = Counter(where[i] for i in range(1600)).most_common()
    assert len(hot) <= 4 and sum(n for _, n in hot[:3]) >= 1400
    assert sum(where[i] != where[i + 1] for i in range(1600, 2400, 2)) <= 4


def test_shards_all_linked(spark):
    rows = [(i, f"text {i // 2}", "en", "s", 1) for i in range(4800)]
    where = {r.doc_id: r.shard for r in sharding.shard_documents(docs_of(spark, rows)).collect()}
    assert set(Counter(where.values()).values()) == {600}
    assert sum(where[i] != where[i + 1] for i in range(0, 4800, 2)) <= 240


def test_shards_of_chained_links_end(spark):
    rng = random.Random(4)
    docs = docs_of(spark, [(i, f"t{i}", "en", "s", 1) for i in range(400)])
    links = spark.createDataFrame([(i, j) for j in range(300) for i in rng.sample(range(400), rng.randint(2, 6))], "doc_id long, link long")
    got = sharding.shard_documents(docs, links=links).collect()
    assert set(Counter(r.shard for r in got).values()) == {50}


def shuffles_above(df, column):
    """Exchanges in the plan of ``df`` that stand above a scan which reads ``column``."""
    held, found = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        held = [(d, l) for d, l in held if d < depth] + [(depth, line)]
        if "FileScan" in line and f"{column}:" in line.split("ReadSchema")[-1]:
            found += [l for _, l in held if "Exchange" in l]
    return found


def test_stages_do_not_shuffle_texts(spark, corpus, monkeypatch):
    tokenizer = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(common, "_BLOCK_BITS", 3)
    docs = docs_of(spark, corpus).repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (exact_dedup.drop_copies, jaccard_join.drop_near_copies, mixing.mixed):
            out = stage(docs)
            assert not shuffles_above(out, "text"), stage
            assert out.count() > 0
        assert not shuffles_above(packing.pack(docs, tokenizer), "ids")
        assert packing.pack(docs, tokenizer).agg(F.countDistinct("doc_id")).first()[0] > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_facts_beside_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "_BLOCK_BITS", 3)
    docs = spark.range(0, 100, 1, 3).select(F.col("id").alias("row_id"), F.lit("t").alias("row_id__block"))
    rows, rid = common.numbered(docs, "facts")
    facts = rows.select(rid, (F.col("row_id") * 2).alias("twice")).repartition(5)
    got = common.beside(rows, rid, facts, "fact")
    assert got.columns == [*docs.columns, rid, "fact"]
    assert sorted((r.row_id, r.fact.twice) for r in got.collect()) == [(i, 2 * i) for i in range(100)]
    for odd in (facts.filter("twice <> 26"), facts.unionByName(facts.filter("twice = 26"))):
        with pytest.raises(Exception, match="not one fact for row"):
            common.beside(rows, rid, odd, "fact").collect()
    none, rid = common.numbered(docs.limit(0), "facts")
    assert common.beside(none, rid, none.select(rid, "row_id"), "fact").count() == 0
