"""Quality, line dedup, licenses, BPE, SimHash and mixing on hostile small tables, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from loamcast.llm import bpe, license_scan, line_dedup, mixing, quality, queries, simhash
from oracle import check

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside must not disturb them.
CLASH = (
    "row long, fp long, size long, __x string, component_id long, n_words long, copies long, target double, posterior double, kept long, base_failed long, "
    "epochs long, source_size long, __size long, __key double, __row long, drop string, site_key string, __lines long, __dropped long, t string, c0 long, c1 long, salt int, root long, rep long, value long, labels string, score double, n long, digest string, id long, s string"
)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 8))) for _ in range(300)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 200))) for _ in range(n // 2)]
    near = []
    for t in texts:
        w = t.split(" ")
        if len(w) > 60:
            w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(texts + near)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "one two"), (None, "null id"), (7, texts[7]), (7, texts[7])]
    rows += [(2000, "word " * 30_000), (2001, "x" * 200_000), (2002, "a b c\n" * 300 + "😀    "), (2003, "\x00\x1f A\x0bB\x0cC")]
    return [(i, t, "en", "s" + str(k % 3) if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def clashing(df):
    names = [x.split(" ")[0] for x in CLASH.split(", ")]
    return df.select("*", *(F.lit("9").cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in CLASH.split(", ") if x.split(" ")[0] in names))


def slow_fingerprint(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, docs):
    rows = docs.collect()
    got = simhash.near_duplicates(clashing(docs)).collect()
    assert len(got) == len(rows)
    fps = {r.text: slow_fingerprint(r.text) for r in rows}
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter((r.doc_id, fps[r.text]) for r in rows)
    nodes = sorted(set(fps.values()))
    group = {f: f for f in nodes}
    for _ in nodes:
        new = {f: min(group[g] for g in nodes if (f ^ g).bit_count() <= 2) for f in nodes}
        if new == group:
            break
        group = new
    least = {}
    for r in rows:
        if r.doc_id is not None:
            g = group[fps[r.text]]
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert {(r.fp & (1 << 64) - 1, r.component_id) for r in got} == {(fps[r.text], least.get(group[fps[r.text]])) for r in rows}


def test_simhash_tiles_and_chains(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    chain = [base[0]]
    for k in range(12):  # each two bits from the one before
        chain.append(chain[-1] ^ (1 << k * 2) ^ (1 << k * 2 + 1))
    fps = list({*base, *chain, *(b ^ 1 for b in base[:10]), 0, (1 << 64) - 1})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for tile in (2, 4096):
        edges = {tuple(sorted(x & (1 << 64) - 1 for x in e)) for e in simhash.links(df, tile=tile).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        group = {f: f for f in fps}
        for _ in fps:
            for a, b in edges:
                group[a] = group[b] = min(group[a], group[b])
        want = {f: f for f in fps}
        for _ in fps:
            want = {f: min(want[g] for g in fps if (f ^ g).bit_count() <= 2) for f in fps}
        assert group == want


def test_simhash_keeps_one_of_each_group(docs, empty):
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    comps = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert kept.count() == comps
    assert simhash.keep_one(empty).count() == simhash.near_duplicates(empty).count() == 0


def slow_quality(text):
    b = (text or "").encode()
    w = [x.decode() for x in WORD.findall(b)]
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(docs, empty):
    rows = docs.collect()
    got = quality.score(clashing(docs)).collect()
    assert Counter((r.doc_id, *r[1:6]) for r in got) == Counter((r.doc_id, *slow_quality(r.text)) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality.score(empty).count() == quality.keep_good(empty).count() == 0
    kept = quality.keep_good(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.count() == sum(r.kept for r in got)
    assert kept.where("posterior = 9 and n_words = 9").count() == kept.count()


def test_quality_verdict_by_hand(docs):
    """kept and posterior of every document by EM written out in plain Python."""
    rows = docs.collect()
    votes = []
    for r in rows:
        b = (r.text or "").encode()
        n, chars, symbols, dup, rep = slow_quality(r.text)
        lines = sum(1 for x in b.split(b"\n") if WORD.search(x))
        letters = sum(1 for w in WORD.findall(b) if w[:1].isalpha() or 0xC3 <= w[0] < 0xF5)
        m = max(n, 1)
        say = lambda good, bad: 1 if bad else 2 if good else 0
        votes.append((say(n >= 100, n < 50), say(rep / m < 0.1, rep / m > 0.5), say(symbols < 0.01 * chars, symbols > 0.1 * chars), say(3.5 <= chars / m <= 9, not 2 <= chars / m <= 14), say(dup == 0, dup > 0.3 * lines), say(letters / m > 0.9, letters / m < 0.6)))
    prior, chance = 0.8, [[{0: 0.2, 1: 0.64, 2: 0.16} for _ in range(6)], [{0: 0.2, 1: 0.16, 2: 0.64} for _ in range(6)]]
    for _ in range(100):
        post = []
        for v in votes:
            good, bad = prior, 1 - prior
            for k in range(6):
                good, bad = good * chance[1][k][v[k]], bad * chance[0][k][v[k]]
            post.append(good / (good + bad))
        for y in (0, 1):
            for k in range(6):
                mass = {x: 1 + sum((p if y else 1 - p) for p, v in zip(post, votes, strict=True) if v[k] == x) for x in range(3)}
                chance[y][k] = {x: q / sum(mass.values()) for x, q in mass.items()}
        prior = (sum(post) + 1) / (len(post) + 2)
    want = Counter((r.doc_id, round(p, 4), p >= 0.5 and not (slow_quality(r.text)[0] < 50 or 100 * slow_quality(r.text)[4] > 50 * slow_quality(r.text)[0])) for r, p in zip(rows, post, strict=True))
    assert Counter((r.doc_id, round(r.posterior, 4), r.kept) for r in quality.score(docs).collect()) == want


def test_em_finds_planted_accuracies():
    r = np.random.default_rng(5)
    y = r.random(20_000) < 0.7
    right = [0.9, 0.8, 0.75, 0.6, 0.85]
    votes = np.zeros((len(y), 5), int)
    for k, p in enumerate(right):
        ok, silent = r.random(len(y)) < p, r.random(len(y)) < 0.3
        votes[:, k] = np.where(silent, 0, np.where(y == ok, 2, 1))
    code, n = np.unique((votes * 3 ** np.arange(5)).sum(axis=1), return_counts=True)
    post = dict(zip(code, quality.fit(code, n.astype(float), 5), strict=True))
    said = np.array([post[c] for c in (votes * 3 ** np.arange(5)).sum(axis=1)]) >= 0.5
    majority = ((votes == 2).sum(axis=1) >= (votes == 1).sum(axis=1)) == y
    assert (said == y).mean() >= majority.mean() - 0.005 and (said == y).mean() > 0.9


def test_quality_on_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.score(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in got if r.quality == 1) and sum(not r.kept for r in got if r.quality == 0) >= 5


def slow_html_lines(html):
    for p in (r"(?s)<!--.*?-->", r"(?s)<(?:script|SCRIPT)[ >].*?</(?:script|SCRIPT)[^>]*>", r"(?s)<(?:style|STYLE)[ >].*?</(?:style|STYLE)[^>]*>"):
        html = re.sub(p, "\n", html)
    out, at = "", 0
    for m in re.finditer(r"<([!/]?)([A-Za-z][A-Za-z0-9]*)?[^>]*>", html):
        if m[1] == "!" or m[2]:
            out += html[at : m.start()] + ("\n" if m[2] and (m[2] in line_dedup.BLOCKS.split("|") or re.fullmatch("[hH][1-6]", m[2])) and m[1] != "!" else "")
            at = m.end()
    return [x for x in (x.strip(" \t\x0b\f\r") for x in (out + html[at:]).split("\n")) if x]


def sites(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, url string, html string, t long, site_key string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    for t in "region nation customer supplier part orders lineitem events embeddings documents benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    return str(tmp_path)


def test_line_dedup_by_host(spark, tmp_path):
    page = "<html><head><title>{0}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><!-- c --><nav><ul><li>Home</li><li>About {1}</li></ul></nav><p>own <b>text</b> {0}<br>second<hr/>  \n\tend {2}</p><footer>Imprint</footer></body></html>"
    rows = [(k, f"http://{'BIG.example.com' if k % 3 else 'user@small.example.org:80'}/p/{k}?q=http://x/", page.format(k, k % 2, k % 20)) for k in range(60)]
    rows += [(100, None, page.format(1, 1, 1)), (101, "http://big.example.com", None), (102, "no url", ""), (103, "", " \n "), (None, "https://big.example.com#f", "Imprint"), (5, rows[5][1], rows[5][2])]
    rows += [(200 + k, f"http://one{k}.example.net/", "<p>Imprint<p>Imprint") for k in range(5)] + [(300, "http://big.example.com/long", "<p>w</p>" * 50_000), (301, "http://big.example.com/a", "<div")]
    d = sites(spark, tmp_path, rows)
    df = queries.op7_line_dedup(spark, d)
    check(df, queries.ORACLES["op7_line_dedup"], d)
    by, host = {}, lambda u: None if u is None else (re.match(line_dedup.HOST, u) or ["", ""])[1].lower()
    for _, u, h in rows:
        by.setdefault(host(u), []).append(set(slow_html_lines(h or "")))
    gone = {u: {x for x in set().union(*v) if (n := sum(x in p for p in v)) >= 3 and n > 0.2 * len(v)} for u, v in by.items()}
    want = Counter()
    for i, u, h in rows:
        if h is None:
            want[i, host(u), 0, 0, None] += 1
        else:
            lines = slow_html_lines(h) or [""]
            kept = [x for x in lines if x not in gone[host(u)]]
            want[i, host(u), len(lines), len(lines) - len(kept), hashlib.md5("\n".join(kept).encode()).hexdigest()] += 1
    assert Counter(map(tuple, df.collect())) == want
    assert {"Home", "Imprint", "About 0"} <= gone["big.example.com"] and gone["one0.example.net"] == set()


def test_line_dedup_is_native_and_keeps_columns(docs, empty, spark):
    out = line_dedup.dedup_lines(clashing(docs), F.col("source"))
    assert out.columns == clashing(docs).columns and out.count() == docs.count()
    assert out.where("site_key = '9' and drop = '9' and c0 = 9").count() == docs.count()
    pages = line_dedup.clean_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    for plan in (out, pages):
        assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().toString())
    assert line_dedup.dedup_lines(empty, F.col("source")).count() == 0
    assert out.where("doc_id = 1000").first().text is None


def test_mixing_equals_sql(spark, tmp_path):
    rows = [r for k, r in enumerate(corpus()) if r[0] is not None and r[0] != 7]
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    check(queries.op3_mixing(spark, str(tmp_path)), queries.ORACLES["op3_mixing"], str(tmp_path))


def test_mixing_targets(docs, empty):
    clash = mixing.mix(clashing(docs))
    assert clash.columns == [*clashing(docs).columns, "___size", "_source_size", "_target", "_copies"]
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert Counter((r.doc_id, r.text, r.copies) for r in got) == Counter((r.doc_id, r.text, r._copies) for r in clash.collect())
    by = {}
    for r in got:
        assert r["__size"] == len(WORD.findall((r.text or "").encode())) and 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r["__size"] for r in v) for s, v in by.items()}
    target = {s: v[0].target for s, v in by.items()}
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    for s, v in by.items():
        assert target[s] <= 2 * sizes[s] + 1e-9
        assert abs(sum(r["__size"] * r.copies for r in v) - target[s]) <= max(r["__size"] for r in v)
    again = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in got) == Counter((r.doc_id, r.text, r.copies) for r in again)
    assert mixing.mixed(docs).count() == sum(r.copies for r in got) and mixing.mixed(clashing(docs)).columns == clashing(docs).columns
    assert mixing.mix(empty).count() == 0


def test_license_base_and_fuzzy(spark, docs, empty):
    texts = {
        1: "Some text. Licensed under CC BY-NC 4.0. All rights reserved, ALL RIGHTS reserved",
        2: "Permision is hereby granted, free of charge, to any persn obtaining a copy of this",
        3: "licensed under the Apache Licence, Version 2.0",
        4: "general public; license",
        5: "redistribution and something else in source",
        6: None,
        7: "permission is hereby granted free of charge to any person obtaining a copy " * 3,
    }
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1].base_labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("cc-by,reserved", 3, 4, 12) and got[1].score == 1.0
    assert got[2].labels == "mit" and got[2].base_labels == "" and 0.9 < got[2].score < 1 and got[2].first_word is None
    assert got[2].spans.startswith("mit:0-13:")
    assert got[3].labels == "apache-2.0" and got[4].base_labels == "gpl" and got[5].labels == "" and got[6].n_words == 0
    assert got[7].spans.count("mit") == 3
    phrases = {"cc-by": b"cc by".split(), "gpl": b"general public license".split(), "reserved": b"all rights reserved".split()}
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r, text in zip(license_scan.scan(clashing(docs)).collect(), [x.text for x in docs.collect()], strict=True):
        w = pattern.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        at = [k for p in phrases.values() for k in range(len(w)) if w[k : k + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(at))
    assert license_scan.scan(empty).count() == 0


RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(docs, empty, reference):
    got = bpe.round_trip(clashing(docs), RANKS, P.PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), True))
    assert Counter(map(tuple, got)) == Counter(want)
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
    ids = bpe.encode(docs, RANKS, P.PATTERN)
    back = bpe.decode(ids, RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())


def test_bpe_streams_and_small_memory(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "TRANSITIONS", 50)
    t, r = bpe.Tokenizer(RANKS, P.PATTERN), random.Random(2)
    for _ in range(300):
        s = "".join(r.choice("aeinrst lé中😀\n1") for _ in range(r.randint(0, 60)))
        assert t.encode(s).tolist() == reference.encode_ordinary(s)
    s = "".join(r.choice("aeinrstlpm") for _ in range(20_000))
    runs = list(t.machine.stream(s.encode()))
    assert len(runs) > 50 and [x for run in runs for x in run] == reference.encode_ordinary(s)


def test_utf8_machine():
    step = bpe.Utf8Machine.feed
    for good in ("é", "中", "😀", "퟿", "\U0010ffff"):
        assert step(0, good.encode()) == 0 and step(0, good.encode()[:-1]) not in (0, 8)
    for bad in (b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x80", b"\xff"):
        assert step(0, bad) == 8
