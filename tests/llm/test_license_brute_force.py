"""License phrases and notices against brute force on texts that hold them."""

import random
import re

from loamcast.llm import license_scan

PHRASES = {"cc-by": "cc by".split(), "gpl": "general public license".split(), "reserved": "all rights reserved".split()}
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def distance(a, b):
    """Least edits that turn a into a part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_base_phrases_equal_brute_force(spark):
    r = random.Random(5)
    vocab = "CC by General PUBLIC license all Rights reserved é x1 cc-by ccby".split()
    rows = [(k, r.choice([" ", "; ", "\n", "--"]).join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for k in range(200)]
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = 0
    for k, text in rows:
        w = PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        at = sorted((i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p)
        seen += len(at)
        want = (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) == want
        assert set(filter(None, got[k].base_labels.split(","))) <= set(filter(None, got[k].labels.split(","))) and (got[k].score == 1) == bool(at)
    assert seen > 100


def test_fuzzy_matches_equal_brute_force():
    r = random.Random(6)
    notices = license_scan._automaton(license_scan.EVERY)[1]
    found = missed = 0
    for _ in range(150):
        words, label, edits, _ = r.choice(notices)
        t = list(words)
        for _ in range(r.randint(0, edits + 3)):
            at = r.randrange(1, len(t) - 1)
            t[at : at + r.randint(0, 1)] = r.choice(["", "q", "z", t[at]])
        line = "some words before " + "".join(t) + " and some behind"
        _, _, spans = license_scan.scan_text(line.encode())
        line = b" " + b" ".join(license_scan.words_of(line.encode())) + b" "
        want = {lab for w, lab, k, _ in notices if distance(w, line.decode("latin-1")) <= k}
        assert {s.label for s in spans} == want
        found, missed = found + (label in want), missed + (label not in want)
    assert found > 50 and missed > 10
