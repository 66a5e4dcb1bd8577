"""License scan: exact base phrases, and fuzzy search for short notices.

A notice of length n may differ by k edits. It is split into k + 1 pieces; by the pigeonhole
principle a text within k edits holds one piece unchanged, so an Aho-Corasick pass over all pieces
locates every candidate. The window around a candidate is then matched by the regex library with
its errors bounded by k, which settles the match and gives its span.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loamcast.llm.common import texts_of

BASE = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}
#: Short notices as lower-case words; one edit is allowed for every EVERY characters.
NOTICES = {
    "licensed under the apache license version": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the terms of the mit license": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "released under the apache license": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "released under the bsd license": "bsd",
    "licensed under the bsd license": "bsd",
    "licensed under the mozilla public license": "mpl-2.0",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this work is licensed under the gnu general public license version": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "subject to the terms of the mozilla public license": "mpl-2.0",
    "licensed under a creative commons attribution": "cc-by",
    "this work is dedicated to the public domain": "public-domain",
    "copyright the authors all rights reserved": "reserved",
}
EVERY = 12
#: A shorter notice is told from others by its license's name alone, so it may differ by one edit.
SHORT = 36
_OTHER = bytes(x for x in range(128) if not (48 <= x <= 57 or 97 <= x <= 122 or 65 <= x <= 90))
_TO_WORDS = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).translate(bytes.maketrans(_OTHER, b" " * len(_OTHER)))
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Span(NamedTuple):
    """A match: its notice's label, the words it covers (from 0, end excluded) and its edits."""

    label: str
    first: int
    end: int
    errors: int
    length: int


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased (A-Z): runs of ASCII letters and digits and all else beyond ASCII."""
    return text.translate(_TO_WORDS).split()


@functools.cache
def _automaton(every: int):
    found: dict[str, list[tuple[int, int]]] = {}
    notices = []
    for k, (words, label) in enumerate(NOTICES.items()):
        edits = max(1, len(words) // every) if len(words) >= SHORT else 1
        cuts = np.linspace(0, len(words), edits + 2).astype(int).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            found.setdefault(words[a:b], []).append((k, a))
        notices.append((words, label, edits, regex.compile(rf"(?b)(?:{regex.escape(words)}){{e<={edits}}}")))
    a = ahocorasick.Automaton()
    for piece, where in found.items():
        a.add_word(piece, (len(piece), where))
    a.make_automaton()
    return a, notices


def fuzzy(line: str, every: int = EVERY) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, errors) of matches in a line of words between single spaces."""
    automaton, notices = _automaton(every)
    near: dict[int, list[tuple[int, int]]] = {}
    for last, (size, where) in automaton.iter(line):
        for k, offset in where:
            words, _, edits, _ = notices[k]
            start = last + 1 - size - offset
            near.setdefault(k, []).append((max(0, start - edits), start + len(words) + edits))
    out = []
    for k, windows in near.items():
        _, _, _, pattern = notices[k]
        windows.sort()
        done = -1
        for a, b in windows:
            if b <= done:
                continue
            # A window right after a settled match may hold the next one: begin where that ended.
            m = pattern.search(line, max(a, 0), min(b, len(line)))
            if m:
                at = (k, m.start(), m.end(), sum(m.fuzzy_counts))
                if not out or out[-1][0] != k or m.start() >= out[-1][2]:
                    out.append(at)
                    done = b
                elif at[3] < out[-1][3]:
                    out[-1] = at
    return out


def scan_text(text: bytes, every: int = EVERY) -> tuple[int, list[Span], list[Span]]:
    """(number of words, base matches, fuzzy matches) of one text."""
    words = words_of(text)
    if not words:
        return 0, [], []
    line = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in BASE.items():
        needle, at = b" " + phrase + b" ", -1
        while (at := line.find(needle, at + 1)) >= 0:
            first = line.count(b" ", 0, at)
            base.append(Span(label, first, first + phrase.count(b" ") + 1, 0, len(phrase)))
    plain, spans = line.decode("latin-1"), []
    if hits := fuzzy(plain, every):
        starts = np.cumsum([1, *(len(w) + 1 for w in words)]).tolist()
        for k, a, b, errors in hits:
            notice, label = _automaton(every)[1][k][:2]
            spans.append(Span(label, max(0, bisect_right(starts, a) - 1), bisect_right(starts, b - 1), errors, len(notice)))
    return len(words), base, spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """(id_col, SCHEMA columns, spans) for every row; a null or wordless text has no words and score 0.

    n_base, first_word, last_word and base_labels are of base phrases alone. labels adds those of fuzzy
    matches; spans lists these as label:first-end:edits. score is 1 for a base phrase, else the best
    match's share of unchanged characters.
    """
    schema = docs.select(id_col).schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split(" "))
    schema = schema.add("spans", "string")

    def run(batches):
        for b in batches:
            rows = []
            for text in texts_of(b.column(1)):
                n, base, spans = scan_text(text, every)
                firsts = [s.first for s in base]
                labels = {s.label for s in base}
                score = 1.0 if base else max((1 - s.errors / s.length for s in spans), default=0.0)
                rows.append((n, len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s.label for s in spans})), score, ";".join(f"{s.label}:{s.first}-{s.end}:{s.errors}" for s in spans)))
            c = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(c, kinds, strict=True))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
