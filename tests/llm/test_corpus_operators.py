"""WARC, LM scoring, cover trees, suffix dedup and the pipeline on hostile small tables."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcast.llm import cover_tree, lm_score, queries, suffix_dedup, warc

PAGES = "page_id long, url string, html string, fp long, payload string"


# WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], PAGES)


def test_warc_round_trip_with_revisits(spark):
    big = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é" * 300_000
    rows = [(k, f"http://h/{k}", ["same", "other é", "", big][k % 4]) for k in range(40)]
    rows += [(100, None, None), (101, "http://a b\n", "x\r\n\r\ny"), (None, "http://n", "same"), (39, "http://h/39", big), (103, "", "lone \x1f\x8b")]
    df = pages(spark, rows).repartition(3)
    got = Counter(map(tuple, warc.read(spark, warc.write(df, records=7), payloads=False).drop("url", "payload").collect()))
    most = {}
    for p, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if p is None else p)
    want = Counter()
    for p, _, h in rows:
        h, first = h or "", most[h or ""]
        again = first != (-1 if p is None else p)
        want[p, len(h.encode()), warc.digest(h.encode()), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    once = warc.read(spark, warc.write(df, least=1 << 30)).collect()
    assert {r.record_type for r in once} == {"response"} and Counter(r.payload for r in once) == Counter(h or "" for _, _, h in rows)
    none = spark.createDataFrame([], PAGES)
    assert warc.read(spark, warc.write(none)).count() == 0


def members(n):
    return [gzip.compress(warc.record(k, f"http://x/{k}", f"payload {k} ".encode() * 20, None, False), mtime=0) for k in range(n)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_recovers_what_follows_damage(zipped):
    parts = members(8) if zipped else [warc.record(k, None, b"payload %d " % k * 20, None, False) for k in range(8)]
    clean = b"".join(parts)
    assert [x["page_id"] for kind, x in warc.salvage(clean) if kind == "record"] == list(range(8))
    assert not [x for kind, x in warc.salvage(clean) if kind == "gap"]
    start = np.cumsum([0, *map(len, parts)]).tolist()
    hurt = bytearray(clean)
    hurt[start[3] - 30] ^= 0x55  # a damaged record
    cut = bytes(hurt[: start[4]]) + bytes(hurt[start[4] + 5 : start[7] + 5])  # a lost head, and a torn end
    found = list(warc.salvage(cut))
    assert [x["page_id"] for kind, x in found if kind == "record"] == [0, 1, 3, 5, 6]
    gaps = [x for kind, x in found if kind == "gap"]
    assert gaps == [(start[2], start[3]), (start[4], start[5] - 5), (start[7] - 5, start[7])]


def test_salvage_never_fails_and_finds_untouched_records():
    r = random.Random(4)
    parts = members(10)
    for _ in range(60):
        k = r.randrange(10)
        hurt = bytearray(parts[k])
        for _ in range(r.randint(1, 4)):
            hurt[r.randrange(len(hurt))] = r.randrange(256)
        noise = bytes(r.randrange(256) for _ in range(r.randint(0, 50)))
        data = b"".join([*parts[:k], bytes(hurt), noise, *parts[k + 1 :]])
        ids = [x["page_id"] for kind, x in warc.salvage(data) if kind == "record"]
        assert set(range(10)) - {k} <= set(ids)
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk")) == [("gap", (0, 4))]


def test_gap_log(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(members(1)[0] + b"junk" + members(2)[1])
    (tmp_path / "b.warc").write_bytes(b"")
    rows = warc.gaps(spark, str(tmp_path)).collect()
    n = len(members(1)[0])
    assert [(r.gap_start, r.gap_end) for r in rows] == [(n, n + 4)]
    assert sorted(r.page_id for r in warc.read(spark, str(tmp_path)).collect()) == [0, 1]


# LM scoring


WORDS = 256


def some_net(seed=2):
    return lm_score.Net(WORDS, np.random.default_rng(seed).normal(0, 0.3, lm_score.Net(WORDS).flat.size))


def test_gradients_match_finite_differences():
    r = np.random.default_rng(1)
    x, fresh = r.integers(0, 40, (6, 3)).astype(np.int32), np.zeros((6, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    y, live = r.integers(0, 60, (6, 3)).astype(np.int32), np.ones((6, 3), bool)
    y[2] = WORDS + 3
    live[4:, 2] = False
    loss = lambda n: -n.output(n.forward(x, fresh, np.zeros((3, lm_score.HIDDEN), np.float32))[0][1:].reshape(-1, lm_score.HIDDEN)[live.ravel()], y.ravel()[live.ravel()])[0].sum(dtype=np.float64)
    before = some_net(1).flat.copy()
    p = lm_score.Net(WORDS, before.copy())
    p.train_window(x, y, live, fresh, np.zeros((3, lm_score.HIDDEN), np.float32), 0.0)
    assert np.array_equal(p.flat, before) and p.seen == live.sum() and p.t == 0  # too few tokens for an update
    gradient = p.grads.flat.copy()
    p.descend(0.0)
    assert p.seen == 0 and p.t == 1 and not p.grads.flat.any() and np.array_equal(p.flat, before)
    pick = r.choice(np.flatnonzero(np.abs(gradient) > 1e-2), 40, replace=False)
    scale = []
    for k in pick:
        up, down = before.copy(), before.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        scale.append((loss(lm_score.Net(WORDS, up)) - loss(lm_score.Net(WORDS, down))) / 2e-2 / gradient[k])
    assert abs(np.mean(scale) - 1) < 0.02 and np.std(scale) < 0.05


def slow_score(net, ids):
    """Natural log probability of a document, one step and one plain softmax at a time."""
    h, total, last = np.zeros(lm_score.HIDDEN), 0.0, net.frequent + lm_score.OTHER
    n, per, sig = lm_score.HIDDEN, lm_score.PER, lambda v: 1 / (1 + np.exp(-v))
    for y in ids.tolist():
        i, u = net.E[last].astype(float), h @ net.U.astype(float)
        z, r = sig(i[:n] + u[:n]), sig(i[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(i[2 * n :] + r * u[2 * n :])
        h = new + z * (h - new)
        cls = h @ net.C.astype(float) + net.c
        k = y // per if y < net.frequent else y - net.frequent + net.frequent // per
        total += cls[k] - np.log(np.exp(cls).sum())
        if y < net.frequent:
            w = net.W[k * per : (k + 1) * per].astype(float) @ h + net.w[k * per : (k + 1) * per]
            total += w[y % per] - np.log(np.exp(w).sum())
        last = y
    return total


def test_state_is_carried_and_probabilities_sum_to_one(monkeypatch):
    net = some_net()
    docs = [np.random.default_rng(k).integers(0, WORDS + lm_score.OTHER, n).astype(np.int32) for k, n in enumerate([1, 5, 300, 77, 64] * 40)]
    whole = lm_score.score_docs(net, docs)  # lanes hold several documents each
    assert np.allclose(whole[:5], [slow_score(net, d) / np.log(10) for d in docs[:5]], rtol=1e-4)
    monkeypatch.setattr(lm_score, "STEPS", 7)
    assert np.allclose(whole, lm_score.score_docs(net, docs), rtol=1e-4)
    assert np.allclose(whole, [lm_score.score_docs(net, [d])[0] for d in docs], rtol=1e-4)
    hs = np.random.default_rng(3).normal(0, 1, (1, lm_score.HIDDEN)).astype(np.float32)
    every = np.arange(WORDS + lm_score.OTHER, dtype=np.int32)
    lp, _ = net.output(np.repeat(hs, len(every), axis=0), every)
    assert abs(np.exp(lp.astype(np.float64)).sum() - 1) < 1e-4


def test_training_does_not_care_for_lengths():
    """As many updates for one long text as for the same tokens in short ones."""
    ids = np.random.default_rng(5).integers(0, WORDS, 3 * lm_score.UPDATE).astype(np.int32)
    for docs in ([ids], np.split(ids, 96), np.split(ids, 6)):
        net = some_net()
        lm_score.train(net, docs, 0.01)
        assert 1 <= net.t <= 4 and net.seen == 0


def test_words_of_the_dictionary(spark, monkeypatch):
    rows = [(f"w{k:05}".encode(), 1 + 40_000 // (k + 1)) for k in range(20_000)]
    counts = spark.createDataFrame(rows, "word binary, c long").repartition(5)
    got = {bytes(r.word): r.c for r in lm_score._most_frequent(counts, 3000).collect()}
    assert 2700 <= len(got) <= 3000 and set(w for w, _ in rows[:2000]) <= set(got)
    assert lm_score._most_frequent(counts, 50_000).count() == 20_000
    flat = lm_score._most_frequent(counts.select("word", F.lit(1).alias("c")), 3000).count()
    assert 2700 <= flat <= 3200
    assert lm_score.frequent(0) == 64 * 16 and lm_score.frequent(10**6) == 64 * 36 and lm_score.frequent(10**8) == 64 * 224


def test_scores_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    a, b, c = ({r.doc_id: r.score for r in lm_score.score(x).collect()} for x in (d.coalesce(1), d.repartition(8), d.repartition(64)))
    assert a.keys() == b.keys() == c.keys()
    assert all(abs(a[k] - v) < 1e-3 * max(1, abs(v)) and abs(b[k] - c[k]) < 1e-3 * max(1, abs(v)) for k, v in b.items())


def test_lm_scores(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()][:400]
    rows += [(5000, None), (5001, ""), (5002, "neverseen" * 20 + " \t once"), (None, "null id"), (3, rows[3][1]), (5006, "Straße " * 20_000)]
    got = lm_score.score(spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, row long, score double").repartition(3)).collect()
    split = lambda t: bytes((t or "").encode()).lower().split() + [lm_score.END]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter()
    for i, t in rows:
        if not out(i):
            c.update(split(t))
    n, v = sum(c.values()), len(c)
    base = Counter()
    for i, t in rows:
        w = split(t)
        base[i, out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == base
    apart = [r for r in got if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Cover trees


def slow_top(rows, k=5):
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % 50 == 0 and i not in out:
            s = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in ok if j != i)[:k]
            out[i] = [(j, -x) for x, j in s]
    return {(i, n + 1, j, s) for i, v in out.items() for n, (j, s) in enumerate(v)}


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 300)
    monkeypatch.setattr(cover_tree, "QUERIES", 5)
    r = random.Random(9)
    rows = [(k, [r.gauss(k % 5, 0.3) for _ in range(8)]) for k in range(700)]
    rows += [(k, [1.0] * 8) for k in range(1000, 1400)]  # a hot vector
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [2.0, 3.0]), (None, [1.0] * 8), (-50, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id long, s long")
    assert {tuple(x) for x in cover_tree.top_k(df.repartition(3)).collect()} == slow_top(rows)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in cover_tree.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert cover_tree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    huge = [(0, [1e9, -1e9]), (1, [1e9, 1e9 + 1]), (2, [3e8, -2e9])]
    assert {tuple(x) for x in cover_tree.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()} == {(0, 1, 2, (1 << 63) - 1), (0, 2, 1, -65536000000000)}


def test_huge_components_take_no_part(spark):
    rows = [(0, [1.0, 1e307]), (50, [1.0, 2.0]), (1, [3.0, 4.0])]
    got = cover_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [tuple(x) for x in got] == [(50, 1, 1, 65536 * 11)]


def clustered(n, d, seed=1):
    r = np.random.default_rng(seed)
    return np.floor(np.concatenate([r.normal(r.normal(0, 4000, d), 40, (n // 8, d)) for _ in range(8)]))


@pytest.mark.parametrize("kind", ["uniform", "clustered", "embeddings", "equal", "line"])
def test_cover_tree_invariants(spark, kind):
    r = np.random.default_rng(1)
    if kind == "embeddings":
        x = np.floor(256 * np.array([v for (v,) in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("embedding").collect()], float))
    else:
        x = {"uniform": np.floor(r.normal(0, 900, (700, 3))), "clustered": clustered(800, 6), "equal": np.ones((200, 3)), "line": np.arange(300.0)[:, None] * [1.0, 2.0]}[kind]
    root = cover_tree.build(x)
    dist = lambda a, b: float(np.sqrt(((x[a] - x[b]) ** 2).sum()))
    assert sorted(root.rows.tolist()) == list(range(len(x)))
    scale, level, nodes = root.radius, [root], 0
    while level:
        nodes += len(level)
        for node in level:  # covering: all rows within the radius, and children are a partition that holds the centre
            assert (np.sqrt(((x[node.rows] - x[node.centre]) ** 2).sum(axis=1)) <= node.radius * (1 + 1e-9) + 1e-9).all()
            if node.children:
                assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
                assert any(node.centre in c.rows for c in node.children)  # nesting
                apart = [dist(a.centre, b.centre) for i, a in enumerate(node.children) for b in node.children[:i]]
                reach = max(dist(c.centre, node.centre) for c in node.children)
                assert min(apart) > reach / 4  # separation: siblings of a level are further apart than its scale
                assert all(c.children or len(c.rows) <= cover_tree.LEAF or c.radius == 0 for c in node.children)
        level = [c for node in level for c in node.children]
    assert nodes > 1 or kind == "equal"


def test_clustered_data_is_pruned(spark, monkeypatch):
    y = clustered(1600, 6)
    tree = cover_tree.build(y)
    rows = np.random.default_rng(3).permutation(1600)[:100]
    scores, who, scored = cover_tree.search_block(y[rows], rows, np.full(100, -np.inf), y, np.arange(1600), tree)
    assert scored < 0.5 * 100 * 1600
    for i, s, w in zip(rows.tolist(), scores, who, strict=True):
        p = y @ y[i]
        p[i] = -np.inf
        best = np.lexsort((np.arange(1600), -p))[:5]
        assert (w, s) == (best.tolist(), p[best].astype(int).tolist())
    monkeypatch.setattr(cover_tree, "BLOCK", 200)
    df = spark.createDataFrame([(k, [float(v) / 256 for v in row]) for k, row in enumerate(y)], "vec_id long, embedding array<double>")
    every, reached, scored = cover_tree.report(df)
    assert every == 32 * 1600 and scored < reached < 0.6 * every


# Suffix dedup


def slow_repeats(rows, w=suffix_dedup.WINDOW):
    """rows in order of documents: (removed bytes, spans, digest of the rest) of each."""
    seen, out = set(), []
    for t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            s = b[k : k + w]
            if s in seen:
                gone[k : k + w] = b"\x01" * w
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "small"), [(suffix_dedup.HOT, False), (2, True)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, small):
    if small:
        monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, copies = prose(70), prose(120)
    rows = [(k, prose(r.randint(0, 150))) for k in range(40)]
    rows += [(100 + k, prose(20) + passage[r.randint(0, 30) : 430 - r.randint(0, 30)] + prose(20)) for k in range(25)]
    rows += [(200 + k, copies) for k in range(30)] + [(300 + k, copies.replace("a", "b", k)) for k in range(12)]
    rows += [(400, "a" * 900), (401, "ab" * 300), (402, prose(30) * 4), (403, None), (404, ""), (405, "x" * 99), (406, copies[:100]), (407, copies[1:101] + "é"), (408, "é" * 120), (-5, passage)]
    rows += [(None, passage + "tail"), (200, "other text of a repeated id " * 9)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, row long, lo long").coalesce(1)
    place = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    want = Counter((rows[k][0], *x) for k, x in zip(place, slow_repeats([rows[k][1] for k in place]), strict=True))
    got = suffix_dedup.cut(df, hot=hot).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.cut(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_under_names_of_the_operators_own(spark):
    rows = [(2, "x" * 150), (1, "x" * 150), (None, None)]
    got = suffix_dedup.cut(spark.createDataFrame(rows, "row long, did string"), "row", "did").drop("kept", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 150, 149, 1), (2, 150, 150, 1), (None, 0, 0, 0)]


def test_deep_shallow_classes():
    r = random.Random(3)
    base = bytes(r.choice(b"ab") for _ in range(400))
    buf = np.frombuffer(base + base[50:300] + b"c" + base[100:260] + bytes(16), np.uint8)
    at = np.arange(len(buf) - 16 - suffix_dedup.WINDOW + 1)
    who, cls = suffix_dedup.equal_suffixes(buf, at, np.zeros(len(at), np.int64))
    data = buf.tobytes()
    groups = Counter(data[k : k + suffix_dedup.WINDOW] for k in at.tolist())
    assert len(who) == sum(n for n in groups.values() if n > 1) and len(set(cls.tolist())) == sum(n > 1 for n in groups.values())
    assert all(len({data[at[w] : at[w] + suffix_dedup.WINDOW] for w in who[cls == c]}) == 1 for c in set(cls.tolist()))


def test_hot_buckets_are_sorted_in_parts():
    r = random.Random(12)
    text = lambda n: bytes(r.choice(b"abc") for _ in range(n))
    shared = [text(100) for _ in range(3)]
    rows = [(7, k, k, 0, 0, r.choice(shared) if r.random() < 0.9 else text(100)) for k in range(400)] + [(9, k, k, 5, 5, shared[0]) for k in range(50)]
    import pyarrow as pa

    table = pa.table({n: pa.array([x[k] for x in rows], pa.binary() if n == "ctx" else pa.int64()) for k, n in enumerate(suffix_dedup.CONTEXT.names)})
    got = {tuple(m) for b in suffix_dedup._sort_buckets(100, most=20)(table.to_batches(30)) for m in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    seen, want = set(), set()
    for g, _, row, _, first, ctx in rows:
        if (g, ctx) in seen:
            want.add((row, first, first))
        seen.add((g, ctx))
    assert got == want


def test_multikey_quicksort_sorts_by_the_shallow_depth():
    r = random.Random(6)
    data = bytes(r.choice(b"ab\x00\xff") for _ in range(3000)) * 2 + bytes(16)
    buf, at = np.frombuffer(data, np.uint8), np.arange(5900)
    bucket = np.array([r.randrange(3) for _ in at], np.int64)
    who, group = suffix_dedup.multikey_quicksort(buf, at, bucket, 8)
    key = lambda k: (bucket[k], data[k : k + 8])
    n = Counter(map(key, at.tolist()))
    assert Counter(map(key, who.tolist())) == {k: v for k, v in n.items() if v > 1}
    assert len({(g, key(k)) for g, k in zip(group.tolist(), who.tolist(), strict=True)}) == len(set(group.tolist())) == sum(v > 1 for v in n.values())
    assert all(len(set(group[i : i + 2].tolist())) == 1 or key(who[i]) != key(who[i + 1]) for i in range(len(who) - 1))


def test_blind_tries_branch_where_members_differ():
    r = random.Random(8)
    head = bytes(r.choice(b"xyz") for _ in range(100))
    texts = [head]
    for k in (24, 31, 32, 33, 63, 64, 95, 96, 98, 99) * 3:
        t = bytearray(r.choice(texts))
        t[k] = r.choice(b"pqr")
        texts += [bytes(t)] * r.randint(1, 3)
    buf = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
    at, who = np.arange(len(texts)) * 100, np.arange(len(texts))
    found, cls = suffix_dedup.blind_tries(buf, at, who, np.zeros(len(who), np.int64), 24, 100)
    want = {t: [k for k, x in enumerate(texts) if x == t] for t in texts if texts.count(t) > 1}
    assert sorted(sorted(found[cls == c].tolist()) for c in set(cls.tolist())) == sorted(want.values())


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept, at = {}, docs
    for k, (name, f) in enumerate(p.STAGES):
        at = f(spark, at, d).cache()
        kept[name] = at.count()
        if k + 1 < len(p.STAGES):
            assert at.columns == docs.columns
    names = [n for n, _ in p.STAGES]
    assert names == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "byte-level bpe"]
    assert docs.count() > kept[names[0]] == kept[names[1]] >= kept[names[2]] and kept[names[3]] == kept[names[4]]
    assert Counter(map(tuple, p.run(spark, d).collect())) == Counter(map(tuple, at.collect()))


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    assert {q.split("_")[0] for q in entry.queries() if q.startswith("op")} == {f"op{n}" for n in range(1, 11)}
    assert "pipeline" in entry.queries()
    assert not any("llm" in f.read_text() for f in Path(queries.__file__).parent.parent.rglob("*.py") if "llm" not in f.parts)


def test_marks_are_sound_when_recomputed(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (Counter(map(tuple, suffix_dedup.cut(x, kept=False).drop("kept").collect())) for x in (d, d.repartition(5)))
    assert a == b
