"""The whole pipeline against plain Python on a small corpus with planted near copies, boilerplate and junk."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from loamcast.llm import bpe, quality
from test_near_dedup import slow_keep_one
from test_text_operators import WORD

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    rows = []
    for k in range(60):
        base = prose(r.randint(60, 220))
        source = f"s{k % 4}" if k % 15 else None
        lines = [" ".join(base[a : a + 20]) for a in range(0, len(base), 20)]
        if k % 2:
            lines.insert(1, "all rights of this site are kept")
        rows.append((3 * k, "\n".join(lines), source))
        if k % 3 == 0:  # a near copy
            near = list(base)
            near[len(near) // 2] = "changed"
            rows.append((3 * k + 1, " ".join(near), source))
        if k % 10 == 0:
            rows.append((3 * k + 2, rows[-1][1], source))
    rows += [(900 + k, "spam word " * 100, "s1") for k in range(5)] + [(950, None, "s1"), (951, "", "s2"), (952, "too short", "s3"), (953, "#### $$$$ %% && " * 60, "s0")]
    r.shuffle(rows)
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows]


def good(rows):
    """Rows whose vote pattern has a posterior of a half or more; EM is held against plain Python elsewhere."""
    measured = [quality.measure((r[1] or "").encode()) for r in rows]
    votes = []
    for n, chars, symbols, dup, rep, lines, letters in measured:
        m = max(n, 1)
        say = lambda yes, no: 1 if no else 2 if yes else 0
        votes.append(sum(3**k * v for k, v in enumerate((say(n >= 100, n < 50), say(rep / m < 0.1, rep / m > 0.5), say(symbols < 0.01 * chars, symbols > 0.1 * chars), say(3.5 <= chars / m <= 9, not 2 <= chars / m <= 14), say(dup == 0, dup > 0.3 * lines), say(letters / m > 0.9, letters / m < 0.6)))))
    codes, counts = np.unique(votes, return_counts=True)
    post = dict(zip(codes.tolist(), quality.fit(codes, counts.astype(float), 6), strict=True))
    return [r for r, v, f in zip(rows, votes, measured, strict=True) if post[v] >= 0.5 and f[0] >= 50 and 100 * f[4] <= 50 * f[0]]


def without_boilerplate(rows):
    pages, held = Counter(r[3] for r in rows), Counter()
    for r in rows:
        held.update({(r[3], x) for x in (r[1] or "").split("\n") if WORD.search(x.encode())})
    gone = {k for k, n in held.items() if n >= 3 and n > 0.2 * pages[k[0]]}
    return [(i, "\n".join(x for x in t.split("\n") if (s, x) not in gone), lang, s, n) for i, t, lang, s, n in rows]


def mixed(rows):
    size = {r: len(WORD.findall(r[1].encode())) for r in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(v for r, v in size.items() if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, budget, target = set(sources), 1.5 * sum(total.values()), {}
    while left:  # fill until no target is above its cap
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * total[s]}
        for s in over or left:
            target[s] = 2 * total[s] if over else level * weight[s]
        budget -= sum(target[s] for s in over)
        left = left - over if over else set()
    out = Counter()
    for s in sources:
        mine = [r for r in rows if r[3] == s]
        epochs = int(target[s] // total[s])
        rest, done = target[s] - epochs * total[s], 0
        key = lambda r: -math.log((int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:12], 16) + 1) / 281474976710657) * (1 + abs(len(r[1]) / size[r] - 6) / 6)
        for r in sorted(mine, key=key):
            done += size[r]
            out[r] += epochs + (2 * done - size[r] < 2 * rest)
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    kept = good(rows)
    cleaned = without_boilerplate(kept)
    single = list(slow_keep_one(cleaned))
    assert len(rows) > len(kept) > len(single) and any("all rights" in r[1] for r in kept) and not all(a == b for a, b in zip(kept, cleaned, strict=True))
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for r, n in mixed(single).items():
        ids = coder.encode_ordinary(r[1])
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest(), True] += n
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == +want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark):
    names = ["c0", "row", "rep", "n_words", "posterior", "drop", "site_key", "target", "epochs", "copies", "__row", "source_size"]
    df = spark.createDataFrame([(*r, *[7] * len(names)) for r in corpus()], DOC + "".join(f", {n} long" for n in names)).coalesce(2)
    for name, f in corpus_pipeline.STAGES[:-1]:
        df = f(spark, df, "")
        assert df.columns == [*(c.split(" ")[0] for c in DOC.split(", ")), *names], name
    assert df.where(" and ".join(f"{n} = 7" for n in names)).count() == df.count() > 0
