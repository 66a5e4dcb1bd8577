"""Exact repeated substrings: bytes covered by a WINDOW-byte string that also starts earlier.

Sorting all suffixes of a corpus at once would move every byte many times, so suffixes are dealt into
buckets that equal windows share. The anchor of a window is its least-hashed GRAM-byte string (the
leftmost of equals); equal windows have equal anchors at equal offsets, and windows in a row mostly
share one, so a bucket entry is an anchor with the run of windows that it serves (its context).

1. Each task lists its anchors as (gram hash, context hash, place). Entries whose context occurred
   earlier in the same slice are marked at once; one of each context goes on.
2. Entries meet by gram hash. Of equal contexts (two 64-bit hashes agree) all but the earliest are
   marked whole; a first entry whose gram also has other contexts becomes a candidate.
3. Candidates' contexts are fetched from the texts, and a bucket's suffixes are sorted deep-shallow:
   three-way multikey quicksort on 8-byte words to a depth of SHALLOW bytes, then blind tries for the
   groups that are equal so far, which compare a suffix with one other and keep branching bytes alone.
   Suffixes that agree on WINDOW bytes end up together, and all but the earliest are marked. A gram with more than HOT
   contexts is dealt anew by the windows' own hashes, and of a window that many contexts share a task
   holds a few at a time.
4. Marks meet their documents, and covered bytes are cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loamcast.llm.common import longs, release, stage, texts_of

WINDOW, GRAM, SHALLOW, HOT = 100, 32, 24, 4096
#: Bytes of text that a task works on at once; documents beyond it go in overlapping segments.
SLICE = 4 << 20
#: Texts with the most copies that are looked up by digest in the first pass; the rest take the general way.
COPIES = 10_000
LAST = (1 << 63) - 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram bytes (a power of two) from each place, by doubling."""
    h, base, size = _BYTE[data], int(_BASE), 1
    while size < gram:
        h = h[:-size] * np.uint64(base) + h[size:]
        base = base * base & 0xFFFFFFFFFFFFFFFF
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def anchors(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(piece, place, first window, last window, gram hash) of all anchors; places count from data's start.

    bounds: starts of the pieces that data joins, and its end; windows never cross a bound.
    """
    empty = np.empty(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    h = gram_hashes(data, gram)
    low = np.uint64(0xFFFFFF)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (_least(v, window - gram + 1) & low).astype(np.int64)
    sizes = np.maximum(np.diff(bounds) - window + 1, 0)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[:-1], sizes)
    at = at[start]
    if not len(at):
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(piece) != 0)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(at)]]) - 1
    return piece[first], at[first], start[first], start[last], h[at[first]]


def _runs(row: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Runs of windows by row, with neighbours joined; sorted by row and place."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    if not len(row):
        return row, lo, hi
    begin = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1] + 1)])
    at = np.flatnonzero(begin)
    return row[at], lo[at], np.maximum.reduceat(hi, at)


ENTRY = T.StructType().add("kind", "byte").add("h", "long").add("c", "long").add("did", "long").add("row", "long").add("pk", "long")


def _list_anchors(copies: dict[bytes, tuple[int, int]], window: int, gram: int):
    """Entries (kind 0: pk is place << 14 | place - first << 7 | place - last) and marks (kind 1: c and pk are first and last)."""

    def out(kind, h, c, did, row, pk):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int8)), longs(h), longs(c), longs(did), longs(row), longs(pk)], names=ENTRY.names)

    def work(part):
        data = np.frombuffer(b"".join(x for _, _, _, x in part), np.uint8)
        bounds = np.cumsum([0, *(len(x) for _, _, _, x in part)])
        piece, at, lo, hi, h = anchors(data, bounds, window, gram)
        if not len(piece):
            return
        view, digest = memoryview(data), xxhash.xxh64_intdigest
        c = np.array([digest(view[a:b], s) for a, b, s in zip(lo.tolist(), (hi + window).tolist(), (at - lo).tolist(), strict=True)], np.uint64).view(np.int64)
        h = h.view(np.int64)
        did, row, skip = (np.array([x[k] for x in part], np.int64)[piece] for k in range(3))
        shift = skip - bounds[:-1][piece]
        lo, hi, at = lo + shift, hi + shift, at + shift
        order = np.lexsort((c, h))  # stable: the earliest of equals stays first
        same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])])
        keep, again = order[~same], order[same]
        yield out(0, h[keep], c[keep], did[keep], row[keep], at[keep] << 14 | (at - lo)[keep] << 7 | (at - hi)[keep])
        if len(again):
            r, a, b = _runs(row[again], lo[again], hi[again])
            yield out(1, r * 0x9E3779B1, a, np.zeros(len(r), np.int64), r, b)

    def run(batches):
        for b in batches:
            did, row = np.asarray(b.column(0)), np.asarray(b.column(1))
            texts, part, size = texts_of(b.column(2)), [], 0
            whole = []
            for k in np.lexsort((row, did)).tolist():
                x = texts[k]
                if len(x) < window:
                    continue
                if copies and (first := copies.get(hashlib.sha256(x).digest())) and first != (did[k], row[k]):
                    whole.append((row[k], len(x) - window))
                    continue
                for s in range(0, len(x) - window + 1, SLICE):
                    seg = x[s : s + SLICE + window - 1]
                    part.append((did[k], row[k], s, seg))
                    size += len(seg)
                    if size >= SLICE:
                        yield from work(part)
                        part, size = [], 0
            if part:
                yield from work(part)
            if whole:
                r = np.array([x for x, _ in whole], np.int64)
                yield out(1, r * 0x9E3779B1, np.zeros(len(r), np.int64), np.zeros(len(r), np.int64), r, np.array([n for _, n in whole], np.int64))

    return run


def _words(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Big-endian 8-byte words of buf from each place."""
    return np.lib.stride_tricks.sliding_window_view(buf, 8)[at].view(">u8").ravel().astype(np.uint64)


def _starts(seg: np.ndarray) -> np.ndarray:
    """Where each run of a sorted segment number begins."""
    return np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(seg) else np.empty(0, np.int64)


def _several(seg: np.ndarray) -> np.ndarray:
    """Whether each place's segment has more than one member."""
    same = seg[1:] == seg[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def multikey_quicksort(buf: np.ndarray, at: np.ndarray, bucket: np.ndarray, depth: int):
    """(suffix numbers, group numbers) of suffixes that share bucket and `depth` bytes with others, sorted by these.

    Three-way multikey quicksort on words of 8 bytes (depth is a multiple), all segments side by side: a
    segment's middle word is its pivot, smaller words come before it and larger ones behind, and only the
    members equal to it go on to the next word. Suffixes are moved by counting. Segments of one drop out.
    """
    who = np.argsort(bucket, kind="stable")
    seg = np.cumsum(np.concatenate([[0], np.diff(bucket[who]) != 0])) if len(who) else who
    at_word = np.zeros(len(who), np.int64)  # of every member, its segment's place in bytes
    done_who, done_seg, base = [], [], 0
    while len(who):
        keep = _several(seg)
        who, seg, at_word = who[keep], seg[keep], at_word[keep]
        deep = at_word >= depth
        if deep.any():
            found = seg[deep]
            done_who.append(who[deep])
            done_seg.append(np.cumsum(np.concatenate([[0], np.diff(found) != 0])) + base)
            base = int(done_seg[-1][-1]) + 1
            who, seg, at_word = who[~deep], seg[~deep], at_word[~deep]
        if not len(who):
            break
        start = _starts(seg)
        size = np.diff(np.concatenate([start, [len(seg)]]))
        key = _words(buf, at[who] + at_word)
        pivot = np.repeat(key[start + size // 2], size)
        less, same = key < pivot, key == pivot
        n_less, n_same = np.add.reduceat(less.astype(np.int64), start), np.add.reduceat(same.astype(np.int64), start)
        # A member's new place: its segment's start, the parts before its own, and those of its part before it.
        rank = lambda hit: np.cumsum(hit) - 1 - np.repeat(np.cumsum(hit)[start] - hit[start], size)
        before, more = np.repeat(start, size), ~(less | same)
        to = before + np.where(less, rank(less), np.where(same, np.repeat(n_less, size) + rank(same), np.repeat(n_less + n_same, size) + rank(more)))
        part = np.repeat(np.arange(len(start)), size) * 3 + same + 2 * more
        new_who, new_seg, new_word = np.empty_like(who), np.empty_like(seg), np.empty_like(at_word)
        new_who[to], new_seg[to], new_word[to] = who, part, at_word + 8 * same
        who, seg, at_word = new_who, new_seg, new_word
    if not done_who:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(done_who), np.concatenate(done_seg)


def _common(buf: np.ndarray, a: np.ndarray, b: np.ndarray, depth: np.ndarray, window: int) -> np.ndarray:
    """Common bytes (window at most) of suffixes at places a and b that are known to share `depth`."""
    out, left = np.full(len(a), window), np.arange(len(a))
    d = depth.copy()
    while len(left):
        x = _words(buf, a[left] + d[left]) ^ _words(buf, b[left] + d[left])
        zero = np.zeros(len(x), np.int64)  # leading bytes that agree
        for k in range(1, 9):
            zero += x < np.uint64(1 << (64 - 8 * k)) if k < 8 else x == 0
        hit = x != 0
        out[left[hit]] = np.minimum(window, d[left[hit]] + zero[hit])
        d[left] += 8
        left = left[~hit & (d[left] < window)]
    return out


def blind_tries(buf: np.ndarray, at: np.ndarray, who: np.ndarray, group: np.ndarray, depth: int, window: int):
    """(suffix numbers, class numbers) of members of a group (contiguous, sharing `depth` bytes) that share `window` with others.

    A group's blind trie keeps branching places and bytes alone. It grows along its spine, the first
    member's path: every other member is compared with it once, from the bytes they are known to share,
    which tells where it leaves the spine. Members that leave at one place by one byte are a subtree, with
    a spine of its own beyond that place; members that never leave equal the first.
    """
    found, classes, n = [], [], 0
    known = np.full(len(who), depth)
    while len(who):
        keep = _several(group)
        who, group, known = who[keep], group[keep], known[keep]
        if not len(who):
            break
        start = _starts(group)
        size = np.diff(np.concatenate([start, [len(group)]]))
        spine = np.repeat(who[start], size)
        first = np.zeros(len(who), bool)
        first[start] = True
        leaves = np.where(first, window, 0)
        leaves[~first] = _common(buf, at[who[~first]], at[spine[~first]], known[~first], window)
        stays = leaves >= window
        some = np.repeat(np.add.reduceat(stays.astype(np.int64), start) > 1, size) & stays
        if some.any():
            found.append(who[some])
            classes.append(np.cumsum(np.concatenate([[0], np.diff(group[some]) != 0])) + n)
            n = int(classes[-1][-1]) + 1
        who, group, leaves = who[~stays], group[~stays], leaves[~stays]
        byte = buf[at[who] + leaves].astype(np.int64)
        branch = (group * (window + 1) + leaves) * 256 + byte
        order = np.argsort(branch, kind="stable")
        who, known, branch = who[order], leaves[order] + 1, branch[order]
        group = np.cumsum(np.concatenate([[0], np.diff(branch) != 0])) if len(branch) else branch
    return (np.concatenate(found), np.concatenate(classes)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def equal_suffixes(buf: np.ndarray, at: np.ndarray, bucket: np.ndarray, window: int = WINDOW, shallow: int = SHALLOW):
    """(suffix numbers, class numbers) of suffixes that share bucket and `window` bytes with others.

    Deep-shallow sorting: multikey quicksort to the shallow depth, blind tries for what is equal there.
    """
    if len(at) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    who, group = multikey_quicksort(buf, at, bucket, shallow)
    return blind_tries(buf, at, who, group, shallow, window)


MARK = T.StructType().add("row", "long").add("lo", "long").add("hi", "long")


def _sort_bucket(rows: list[tuple], window: int):
    """Marks (row, lo, hi) of a list of buckets of (g, did, row, place, first, context), and whether a context has windows without one."""
    size = np.array([len(r[5]) for r in rows], np.int64)
    buf = np.frombuffer(b"".join(r[5] for r in rows) + bytes(16), np.uint8)
    begin = np.cumsum(size) - size
    wins = size - window + 1
    which = np.repeat(np.arange(len(rows)), wins)
    within = np.arange(len(which)) - np.repeat(np.cumsum(wins) - wins, wins)
    g = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
    did, row, place, first = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))
    offset = place[which] - first[which] - within
    who, cls = equal_suffixes(buf, begin[which] + within, g[which] * 128 + offset, window)
    start = first[which[who]] + within[who]
    order = np.lexsort((start, row[which[who]], did[which[who]], cls))
    later = order[np.concatenate([[False], cls[order][1:] == cls[order][:-1]])] if len(order) else order
    marked = np.bincount(which[who[later]], minlength=len(rows))
    return _runs(row[which[who[later]]], start[later], start[later]), marked < wins


def _sort_buckets(window: int, most: int = 3000):
    """Marks of buckets that come one after the other, each in order of documents.

    Buckets are sorted together until they have `most` contexts. Of a bucket with more than twice as
    many, those whose windows all came earlier are let go of in between, so that it is never held whole.
    """

    def run(batches):
        def batch(marks):
            return pa.RecordBatch.from_arrays([longs(c) for c in marks], names=MARK.names)

        rows: list[tuple] = []
        limit = most
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(rows) >= most:
                    if x[0] != rows[-1][0]:
                        yield batch(_sort_bucket(rows, window)[0])
                        rows, limit = [], most
                    elif len(rows) >= 2 * limit:
                        marks, first = _sort_bucket(rows, window)
                        yield batch(marks)
                        rows = [r for r, f in zip(rows, first.tolist(), strict=True) if f and r[0] == x[0]]
                        limit = max(most, len(rows))
                rows.append(x)
        if rows:
            yield batch(_sort_bucket(rows, window)[0])

    return run


CONTEXT = T.StructType().add("g", "long").add("did", "long").add("row", "long").add("place", "long").add("first", "long").add("ctx", "binary")


def _fetch_contexts(window: int, hot: int):
    def run(batches):
        for b in batches:
            out = []
            for did, row, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist(), strict=True):
                for x in wanted:
                    place = x["pk"] >> 14
                    lo, hi = place - (x["pk"] >> 7 & 127), place - (x["pk"] & 127)
                    if x["n"] <= hot:
                        out.append((x["h"], did, row, place, lo, text[lo : hi + window]))
                    else:
                        out += [(xxhash.xxh64_intdigest(text[i : i + window]) - (1 << 63), did, row, i, i, text[i : i + window]) for i in range(lo, hi + 1)]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


_ARROW = pa.schema([(f, pa.int64()) for f in CONTEXT.names[:-1]] + [("ctx", pa.binary())])


def marks(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(row, lo, hi): windows lo..hi of a row start with `window` bytes that also start earlier.

    keyed: did (order of documents), row (unique, breaks ties), text.
    """
    sha = keyed.select("did", "row", F.col("text").cast("binary").alias("b")).where(F.length("b") >= window).groupBy(F.unhex(F.sha2("b", 256)).alias("sha"))
    counts = sha.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("did", "row")).alias("m")).where("n >= 16")
    copies = {bytes(r[0]): (r[1], r[2]) for r in counts.orderBy(F.desc("n"), "sha").limit(COPIES).select("sha", "m.did", "m.row").collect()}
    entries = keyed.select("did", "row", "text").mapInArrow(_list_anchors(copies, window, gram), ENTRY).repartition("h")
    by_h, by_hc = Window.partitionBy("kind", "h"), Window.partitionBy("kind", "h", "c").orderBy("did", "row", "pk")
    ranked = entries.withColumn("rn", F.row_number().over(by_hc)).withColumn("n", F.sum((F.col("rn") == 1).cast("int")).over(by_h))
    level = stage(ranked.where("kind = 1 or rn > 1 or n > 1"), "repeat-anchors")
    del entries, ranked
    release(keyed.sparkSession)
    place = F.shiftright("pk", 14)
    first, last = place - F.shiftright("pk", 7).bitwiseAND(F.lit(127)), place - F.col("pk").bitwiseAND(F.lit(127))
    known = level.where("kind = 1").select("row", F.col("c").alias("lo"), F.col("pk").alias("hi"))
    known = known.union(level.where("kind = 0 and rn > 1").select("row", first.alias("lo"), last.alias("hi")))
    wanted = level.where("kind = 0 and rn = 1 and n > 1").groupBy("row").agg(F.collect_list(F.struct("h", "pk", "n")).alias("wanted"))
    contexts = keyed.select("did", "row", "text").join(wanted, "row").select("did", "row", "text", "wanted").mapInArrow(_fetch_contexts(window, hot), CONTEXT)
    sorted_ = contexts.repartition("g").sortWithinPartitions("g", "did", "row", "place").mapInArrow(_sort_buckets(window), MARK)
    out = stage(known.union(sorted_), "repeat-marks")
    return out


def cover(size: int, lo: list[int], hi: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows lo..hi."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo, hi, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window)
        else:
            out.append([a, b + window])
    return [(a, min(b, size)) for a, b in out]


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, kept: bool = True) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row.

    Documents are ordered by id, null ids last, rows with equal ids as they come, so of repeated rows the
    first stays. Null texts are empty; texts shorter than the window lose nothing; long ones are read whole,
    in overlapping segments. An empty table gives an empty result. Other columns of docs aren't read,
    whatever they are called. kept=False leaves the remaining bytes out.
    """
    # Rows get their numbers once: a later scan may split the files in another way.
    keyed = stage(docs.select(F.col(id_col).alias("ident"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("did"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")), "documents")
    found = marks(keyed, window, gram, hot).groupBy("row").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    schema = docs.select(id_col).schema
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, "long")
    schema = schema.add("kept_sha256", "string").add("kept", "binary")

    def run(batches):
        for b in batches:
            rows = []
            for x, lo, hi in zip(texts_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                spans = cover(len(x), lo or [], hi or [], window)
                at, left = 0, []
                for s, e in spans:
                    left.append(x[at:s])
                    at = e
                rest = b"".join([*left, x[at:]]) if spans else x
                rows.append((len(x), len(x) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if kept else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return keyed.join(found, "row", "left").select("ident", "text", "lo", "hi").mapInArrow(run, schema)
