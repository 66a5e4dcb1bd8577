"""The pipeline's near-dedup against brute force over all pairs."""

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loamcast.llm import near_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().encode().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def slow_keep_one(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for k, g in enumerate(group):
        key = (rows[k][0] is None, rows[k][0] or 0, k)
        best[g] = min(best.get(g, key), key)
    return Counter(rows[k] for _, _, k in best.values())


def planted(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    passage, texts = prose(40), []
    for n in (4, 5, 6, 30, 100, 100, 300, 300, 1000):
        base = prose(n)
        texts.append(base)
        for share in (0.002, 0.01, 0.02, 0.025, 0.04, 0.1):
            w = list(base)
            for k in r.sample(range(n), max(1, round(share * n))):
                w[k] = word()
            texts.append(w)
        texts += [base[: n * 9 // 10], base[: n * 8 // 10], base + passage, base]
    hot = prose(120)
    for _ in range(40):
        w = list(hot)
        w[r.randrange(120)] = word()
        texts.append(w)
    texts += [prose(60) + passage for _ in range(10)] + [passage + prose(10) for _ in range(5)] + [[], ["one"], ["One"], ["one", "two"]]
    r.shuffle(texts)
    ids = [k if k % 5 else None for k in range(len(texts))]
    return [(i, " ".join(t), "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)] + [(900, None, "en", "s", 0), (None, None, "en", "s", 0)]


def test_near_dedup_stage_equals_brute_force(spark, sf):
    rows = planted()
    df = spark.createDataFrame(rows, DOC).coalesce(1)
    got = corpus_pipeline.simhash_near_dedup(spark, df, sf)
    assert got.columns == df.columns
    assert Counter(map(tuple, got.collect())) == slow_keep_one(rows)


def test_near_dedup_in_small_tiles_with_clashing_columns(spark):
    rows = planted(7)
    df = spark.createDataFrame([(*r, 3, "x", 4) for r in rows], DOC + ", row long, digest string, rep long").coalesce(1)
    got = near_dedup.keep_one(df, tile=3)
    assert got.columns == df.columns
    assert Counter(tuple(x)[:5] for x in got.collect()) == slow_keep_one(rows)


def test_near_dedup_whatever_values_are_common(spark, monkeypatch):
    rows = planted(8)
    df = spark.createDataFrame(rows, DOC).coalesce(1)
    for every, often, most in ((1, 2, 50), (1, 1, 1 << 18)):
        monkeypatch.setattr(near_dedup.common_values, "__defaults__", (every, often, most))
        assert Counter(map(tuple, near_dedup.keep_one(df).collect())) == slow_keep_one(rows)


def test_near_dedup_links_replaced_words(spark):
    r = random.Random(9)
    rows = []
    for k in range(30):
        base = [f"w{r.randrange(5000)}" for _ in range(400)]
        near = [f"n{k}" if j % 100 == 50 else w for j, w in enumerate(base)]
        rows += [(2 * k, " ".join(base), "en", "s", 1), (2 * k + 1, " ".join(near), "en", "s", 1)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, DOC).repartition(3))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(0, 60, 2))


def test_near_dedup_of_an_empty_table(spark):
    assert near_dedup.keep_one(spark.createDataFrame([], DOC)).count() == 0


def near_fingerprints(seed=11):
    """Sets (rep, root, n, fp) around a few fingerprints, and their pairs that can be linked."""
    r = np.random.default_rng(seed)
    centres, rows = r.integers(0, 2**64, (12, 4), np.uint64), []
    for rep in range(400):
        flips = np.zeros(256, np.uint8)
        flips[r.choice(256, r.integers(0, 16), replace=False)] = 1
        fp = centres[r.integers(12)] ^ np.packbits(flips).view(np.uint64)
        rows.append((rep * 3, rep * 3, int(r.choice([4, 5, 8, 9, 50, 60, 62, 63, 250, 300, 312, 313])), fp.tobytes()))
    pairs = {}
    for (u, _, n, f), (v, _, m, g) in itertools.combinations(rows, 2):
        most = min(n, m) - (n == m)
        apart = int(np.bitwise_count(np.frombuffer(f, np.uint64) ^ np.frombuffer(g, np.uint64)).sum())
        radius = near_dedup.RADIUS if min(n, m) < near_dedup.LONG else near_dedup.RADIUS_LONG
        if apart <= radius and 5 * most >= 4 * (n + m - most):
            pairs[u, v] = 1 + radius - apart
    return rows, pairs


def groups_of(pairs):
    root = {x: x for p in pairs for x in p}
    for u, v in pairs:
        a, b = root[u], root[v]
        root = {x: min(a, b) if g in (a, b) else g for x, g in root.items()}
    return root


def test_tiles_find_every_pair_of_near_fingerprints(spark):
    rows, pairs = near_fingerprints()
    df = spark.createDataFrame(rows, "rep long, root long, n long, fp binary").repartition(5)
    for tile in (7, near_dedup.CELL_TILE):
        found = near_dedup._ByFingerprints(df, tile)
        spanning = found.tiled(df).collect()
        forest = [(x.u, x.v) for x in spanning if x.u != x.v]
        assert set(forest) <= set(pairs) and groups_of(forest) == groups_of(pairs)
        assert len(pairs) > 1000 and (tile == 7 or len(forest) < len(pairs) / 2)
        assert sum(x.weight for x in spanning) == 2 * sum(pairs.values())
        known = df.withColumn("root", F.lit(1).cast("long"))
        assert found.tiled(known).count() == 0


def test_fingerprints_alone_find_the_pipelines_links(spark, sf, monkeypatch):
    """No set meets another by its values; groups within the radius of which not all are linked are told apart."""
    monkeypatch.setattr(near_dedup, "common_values", None)
    monkeypatch.setattr(near_dedup._Links, "find", None)
    r, rows = random.Random(12), planted(10)
    for k in range(3):
        base = [f"w{r.randrange(9000)}" for _ in range(200)]
        for j in range(40):
            near = list(base)
            for at in r.sample(range(200), 3 + j % 3):
                near[at] = f"n{r.randrange(9000)}"
            rows.append((1000 + 50 * k + j, " ".join(near), "en", "s", 1))
    df = spark.createDataFrame(rows, DOC).coalesce(1)
    want = slow_keep_one(rows)
    assert Counter(map(tuple, corpus_pipeline.simhash_near_dedup(spark, df, sf).collect())) == want
    assert Counter(map(tuple, near_dedup.simhash_keep_one(df, tile=3).collect())) == want
    assert near_dedup.simhash_keep_one(df.limit(0)).count() == 0
