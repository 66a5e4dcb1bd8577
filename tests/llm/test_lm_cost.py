"""op2's words and network against plain Python, in results and in CPU time."""

import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from loamcast.llm import lm_score

ODD = [None, "", " \n ", "Ä\x1cB \x0b\x0c C\r", "neverseen x neverseen", "\xa0 ǅ", "\n"]


def plain(texts, voc):
    """The columns CODED, word by word."""
    out = []
    for t in texts:
        words, known, logs, part, rare, ids = [*(t or "").encode().lower().split(), lm_score.END], 0, 0.0, 0.0, [], []
        for w in words:
            k = voc.words.get(w, -1)
            log = voc.log_count[k] if k >= 0 else 0.0
            known, logs = known + (k >= 0), logs + log
            if 0 <= k < voc.frequent:
                ids.append(k)
            else:
                c = zlib.crc32(w[-3:]) % lm_score.OTHER
                ids.append(voc.frequent + c)
                part += log - voc.class_words[c]
            rare += [w] * (k < 0)
        out.append((len(words), known, logs, part, b" ".join(rare), np.array(ids, np.int32).tobytes()))
    return out


def test_coded_texts_equal_plain_python_and_cost_less():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    found = sorted({w for t in texts for w in (t or "").encode().lower().split()} - {b"x"})[::2]
    r = np.random.default_rng(4)
    for words in ([lm_score.END, *found], found, []):  # the end itself may be missing
        voc = lm_score.Vocabulary({w: k for k, w in enumerate(words)}, r.random(len(words)), r.random(lm_score.OTHER), 1, 1)
        coder, column = lm_score._Coder(voc), pa.array(ODD + texts + ODD)
        got = list(zip(*(c.to_pylist() for c in coder(column)), strict=True))
        for a, b in zip(got, plain(ODD + texts + ODD, voc), strict=True):
            assert a[:2] + a[4:] == b[:2] + b[4:] and np.allclose(a[2:4], b[2:4], rtol=1e-9)
        large = coder(column.cast(pa.large_string()).slice(2, 9))
        assert [c.to_pylist() for c in large] == [c.slice(2, 9).to_pylist() for c in coder(column)]

    def split():  # what any word-by-word way does at least
        for t in texts:
            list(map(voc.words.get, (t or "").encode().lower().split()))

    every = [lm_score.END, *{w for t in texts for w in (t or "").encode().lower().split()}]
    voc = lm_score.Vocabulary({w: k for k, w in enumerate(every)}, r.random(len(every)), r.random(lm_score.OTHER), 1, 1)
    coder, column = lm_score._Coder(voc), pa.array(texts * 4)
    took = {"split": [], "coder": []}
    for _ in range(5):
        a = time.process_time()
        [split() for _ in range(4)]
        b = time.process_time()
        coder(column)
        took["split"].append(b - a)
        took["coder"].append(time.process_time() - b)
    assert min(took["coder"]) < min(took["split"])


def test_far_logits_are_shifted():
    net = lm_score.Net(256, np.random.default_rng(2).normal(0, 0.3, lm_score.Net(256).flat.size))
    net.c += 500  # leaves every probability as it was
    net.w -= 500
    hs = np.random.default_rng(3).normal(0, 0.3, (1, lm_score.HIDDEN)).astype(np.float32)
    every = np.arange(256 + lm_score.OTHER, dtype=np.int32)
    far = net.output(np.repeat(hs, len(every), axis=0), every)[0]
    net.c -= 500
    net.w += 500
    near = net.output(np.repeat(hs, len(every), axis=0), every)[0]
    assert np.isfinite(far).all() and np.allclose(far, near, atol=1e-3)
    assert abs(np.exp(far.astype(np.float64)).sum() - 1) < 1e-3
