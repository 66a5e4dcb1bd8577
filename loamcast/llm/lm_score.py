"""Scoring texts with a gated recurrent language model.

Words are predicted one by one with a class-factored softmax: the recurrent state gives a
distribution over classes; a class of frequent words has a softmax over its members, and a class of
other words (told apart by their last bytes) gives a word its share of the class's smoothed training
count. Probabilities of all known words and one unknown word per class sum to one. The words with outputs
of their own grow with the square root of the vocabulary.

Counts come from all training texts. The network starts from WARM documents (least hash first), then
goes over all training texts once, in ROUNDS rounds. Texts belong to shards by a hash of themselves, whose
number grows with the square root of the training tokens; in each round every shard trains a copy by
truncated backpropagation, and the copies are averaged by their tokens before the next. Nothing depends on
how the input is partitioned. Every update of the parameters follows UPDATE tokens or more, whatever the
texts' lengths.

State is carried across windows, which only cut the gradient: from a document's first word to its end in
scoring, over SPAN tokens in training. Words beyond the dictionary that workers hold are looked up by a
join, so no vocabulary is ever held whole.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loamcast.llm.common import longs, slices, stage

#: Frequent words with outputs of their own come in classes of PER: LEAST classes, and one more for each WIDTH of
#: the square root of the distinct words; classes of other words; hidden units.
PER, LEAST, WIDTH, OTHER, HIDDEN = 64, 16, 48, 32, 24
#: Words (of LONGEST bytes at most) whose counts every worker holds, if frequent ones aren't more.
KEEP, LONGEST = 131_072, 256
#: Documents of the start, and rounds after which the shards' copies are averaged.
WARM, ROUNDS = 2048, 4
#: A corpus of SHARD tokens has one shard, one of k * k times as many has k; vectors of shards are summed in
#: so many groups before they reach the driver.
SHARD, GROUPS = 100_000, 4
#: Steps of a backpropagation window, lanes read side by side, tokens laid out at once.
STEPS, LANES, POOL = 32, 512, 6_000_000
#: Tokens of an update at least, and tokens over which a document's state is carried in training.
UPDATE, SPAN = 8192, 1024
#: Tokens whose class logits are worked out at once.
BLOCK = 2048
#: Logits nearer to zero than this need no shift by their maximum before exp.
FAR = 60
#: Bound on each state's gradient as it goes back in time.
CLIP = 8
#: In scoring, texts of more tokens are read by tasks of their own, each for so many input partitions: a lane
#: is as long as its longest document, so short ones would wait for them. This changes no score.
LONG, TOGETHER = 2560, 4
RATE = 0.06
END = b"\n"


def start(voc: Vocabulary) -> np.ndarray:
    """Parameters of a network whose biases give the training counts' own distribution."""
    net, n = Net(voc.frequent), min(voc.frequent, len(voc.words))
    net.w[:] = -30  # numbers without a word
    net.w[:n] = voc.log_count[:n] * np.log(10)
    head = net.frequent // PER
    mass = np.exp(net.w.astype(np.float64)).reshape(head, PER).sum(axis=1)
    net.c[:head] = np.log(mass)
    net.c[head:] = voc.class_words * np.log(10)
    net.c -= net.c.max()
    return net.flat


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts as binary, words of each); null is no text. Ends are left out."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    lists = pc.ascii_split_whitespace(texts)
    n, words = np.asarray(pc.list_value_length(lists), np.int64), lists.flatten()
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0).cast(pa.int8()), np.int64)
    if empty.any():  # an empty text is split into one empty word
        n, words = n - empty, words.filter(pc.greater(pc.binary_length(words), 0))
    return words.cast(kind).cast(pa.binary()), n


def held_out(ident: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id is training data."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def other_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % OTHER


def other_classes(words: pa.Array) -> np.ndarray:
    """other_class of all words of a binary array at once."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data, length = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(ends)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        rows = np.flatnonzero(length >= back)
        old = crc[rows]
        crc[rows] = CRC[(old ^ data[ends[1:][rows] - back]) & 255] ^ (old >> 8)
    return (~crc % OTHER).astype(np.int32)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def frequent(distinct: int) -> int:
    return PER * (LEAST + math.isqrt(distinct) // WIDTH)


class Vocabulary(NamedTuple):
    """What all workers hold: KEEP words, or the frequent ones if these are more."""

    words: dict  # word -> its number, most frequent first
    log_count: np.ndarray  # log10(count + 0.5) by number
    class_words: np.ndarray  # log10 of the smoothed training tokens of each class of other words
    total: int
    distinct: int

    @property
    def frequent(self) -> int:
        """Numbers of words with outputs of their own; the last few may have no word."""
        return frequent(self.distinct)


class Net:
    """The network: parameters in one vector, so that copies can be averaged."""

    def __init__(self, frequent: int, flat: np.ndarray | None = None):
        h, self.frequent, self.classes = HIDDEN, frequent, frequent // PER + OTHER
        shapes = {"E": (frequent + OTHER + 1, 3 * h), "U": (h, 3 * h), "C": (h, self.classes), "c": (self.classes,), "W": (frequent, h), "w": (frequent,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.08, size)
        self.flat, at = flat.astype(np.float32), 0  # a copy
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n
        self.m = self.v = self.grads = None  # made when training begins
        self.t, self.seen, self.space = 0, 0, {}

    def buffer(self, name: str, *shape: int) -> np.ndarray:
        """Memory that is used again: what a window fills is read before the next one begins."""
        size = math.prod(shape)
        if name not in self.space or len(self.space[name]) < size:
            self.space[name] = np.empty(size, np.float32)
        return self.space[name][:size].reshape(shape)

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States (steps, lanes, hidden) after inputs x, the last state, and what the backward pass needs.

        fresh marks where a document begins.
        """
        # Gates lie in arrays of their own, so that every step reads and writes memory in one run.
        n, (steps, lanes) = HIDDEN, x.shape
        states = self.buffer("states", steps + 1, lanes, n)
        states[0] = h
        inputs, rows, thirds = self.buffer("inputs", 3, steps, lanes, n), np.multiply(x, 3, dtype=np.intp), self.E.reshape(-1, n)
        for k in range(3):
            np.take(thirds, rows + k, axis=0, out=inputs[k], mode="clip")
        mix = np.ascontiguousarray(self.U.reshape(n, 3, n).transpose(1, 0, 2))
        np.negative(mix[:2], out=mix[:2])  # gates are 1 / (1 + exp(-sum))
        length = steps if keep else 1
        befores, news = self.buffer("befores", length, lanes, n), self.buffer("news", length, lanes, n)
        gates, us = self.buffer("gates", length, 2, lanes, n), self.buffer("us", length, 3, lanes, n)
        step, lane = np.nonzero(fresh)
        cuts = np.searchsorted(step, np.arange(steps + 1)).tolist()
        with np.errstate(over="ignore"):  # exp may reach infinity, where gates are 0 and tanh is 1
            for t in range(steps):
                at, before, after = t if keep else 0, states[t], states[t + 1]
                if keep or cuts[t] < cuts[t + 1]:  # a copy: the state that ended the document before is still scored
                    befores[at] = before
                    before = befores[at]
                    before[lane[cuts[t] : cuts[t + 1]]] = 0
                u, gate, new = np.matmul(before, mix, out=us[at]), gates[at], news[at]
                np.subtract(u[:2], inputs[:2, t], out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(gate[1], u[2], out=new)
                new += inputs[2, t]
                new *= 2  # tanh(a) is 1 - 2 / (exp(2 a) + 1)
                np.exp(new, out=new)
                new += 1
                np.divide(2, new, out=new)
                np.subtract(1, new, out=new)
                np.subtract(before, new, out=after)
                after *= gate[0]
                after += new
        return states, states[-1].copy(), (befores, gates[:, 0], gates[:, 1], us[:, 2], news) if keep else None

    def output(self, hs: np.ndarray, y: np.ndarray, grads=None):
        """Natural log probabilities of targets y (class part, and word part of frequent words).

        y is a frequent word's number, or self.frequent + class. With grads, also the states' gradient.
        """
        # Classes lie along the first axis, so that sums over them run along memory. A last state of 1 bears the biases.
        head = self.frequent // PER
        small = np.int16 if self.classes < 1 << 15 else np.int32  # which numpy sorts by radix
        cls = np.where(y < self.frequent, y // PER, y - self.frequent + head).astype(small)
        # Targets sorted by class, so that a class's columns are a slice.
        order = np.argsort(cls, kind="stable")
        cls, y = cls[order], y[order]
        ones = self.buffer("ones", len(y), HIDDEN + 1)
        ones[:, HIDDEN] = 1
        ones[:, :HIDDEN] = np.take(hs, order, axis=0)
        C, W = np.vstack([self.C, self.c]).T.copy(), np.hstack([self.W, self.w[:, None]])
        far_c, far_w = _far(C), _far(W)
        ends = np.searchsorted(cls, np.arange(head + 1)).tolist()
        lp, dh = np.empty(len(y), np.float32), None if grads is None else np.empty((len(y), HIDDEN), np.float32)
        for a in range(0, len(y), BLOCK):  # few enough at once that their logits stay in the cache
            at = slice(a, min(a + BLOCK, len(y)))
            logits = np.matmul(C, ones[at].T, out=self.buffer("logits", len(C), at.stop - a))
            if far_c:
                logits -= logits.max(axis=0)
            rows, wanted = np.arange(logits.shape[1]), cls[at]
            target = logits[wanted, rows]
            np.exp(logits, out=logits)
            total = logits.sum(axis=0)
            lp[at] = target - np.log(total)
            if grads is not None:
                logits /= total
                logits[wanted, rows] -= 1
                g = ones[at].T @ logits.T
                grads.C += g[:HIDDEN]
                grads.c += g[HIDDEN]
                np.matmul(logits.T, self.C.T, out=dh[at])
        rows = np.arange(len(y))
        for k in range(head):
            at, own = slice(ends[k], ends[k + 1]), slice(k * PER, (k + 1) * PER)
            if ends[k] == ends[k + 1]:
                continue
            s = np.matmul(W[own], ones[at].T, out=self.buffer("inner", PER, at.stop - at.start))
            if far_w:
                s -= s.max(axis=0)
            inner, i = y[at] - k * PER, rows[: ends[k + 1] - ends[k]]
            hit = s[inner, i]
            np.exp(s, out=s)
            sums = s.sum(axis=0)
            lp[at] += hit - np.log(sums)
            if grads is not None:
                s /= sums
                s[inner, i] -= 1
                g = s @ ones[at]
                grads.W[own] += g[:, :HIDDEN]
                grads.w[own] += g[:, HIDDEN]
                dh[at] += s.T @ self.W[own]
        sorted_lp, lp = lp, np.empty_like(lp)
        lp[order] = sorted_lp
        if dh is not None:
            sorted_dh, dh = dh, np.empty_like(dh)
            dh[order] = sorted_dh
        return lp, dh

    def train_window(self, x, y, live, fresh, h, rate):
        """Add a window's gradient, and descend where UPDATE tokens have been seen; returns the state after it."""
        states, h_end, (before, z, r, un, new) = self.forward(x, fresh, h, True)
        if self.grads is None:
            self.m, self.v, self.grads, self.scratch = np.zeros_like(self.flat), np.zeros_like(self.flat), Net(self.frequent, self.flat), np.empty_like(self.flat)
            self.grads.flat[:] = 0
        g, n, (steps, lanes) = self.grads, HIDDEN, x.shape
        # Input t is the token before target t, which the state after it predicts.
        hs, targets, on = states[1:].reshape(-1, n), np.ascontiguousarray(y).ravel(), np.flatnonzero(live.ravel())
        if len(on) == len(targets):
            dh_out = self.output(hs, targets, g)[1]
        else:
            dh_out = np.zeros((steps * lanes, n), np.float32)
            dh_out[on] = self.output(hs[on], targets[on], g)[1]
        dh_out = dh_out.reshape(steps, lanes, n)
        du, dn_all, carry = self.buffer("du", 3, steps, lanes, n), self.buffer("dn", steps, lanes, n), np.zeros((lanes, n), np.float32)
        back, begins = np.ascontiguousarray(self.U.reshape(n, 3, n).transpose(1, 2, 0)), fresh.any(axis=1)
        rest, part, parts = np.empty_like(carry), np.empty_like(carry), np.empty((3, lanes, n), np.float32)
        for t in range(steps - 1, -1, -1):
            carry += dh_out[t]
            dn, dz, dr, dun = dn_all[t], du[0, t], du[1, t], du[2, t]
            np.subtract(1, z[t], out=rest)
            np.subtract(before[t], new[t], out=part)
            part *= z[t]
            part *= rest
            np.multiply(carry, part, out=dz)
            np.multiply(new[t], new[t], out=part)
            np.subtract(1, part, out=part)
            part *= rest
            np.multiply(carry, part, out=dn)
            np.multiply(dn, r[t], out=dun)
            np.subtract(1, r[t], out=part)
            part *= un[t]
            np.multiply(dun, part, out=dr)
            carry *= z[t]
            for x_back in np.matmul(du[:, t], back, out=parts):
                carry += x_back
            np.clip(carry, -CLIP, CLIP, out=carry)  # over a long window it could grow without bound
            if begins[t]:
                carry[fresh[t]] = 0
        olds = before.reshape(-1, n).T
        for k in range(3):
            g.U[:, k * n : (k + 1) * n] += olds @ du[k].reshape(-1, n)
        ids = x.ravel()
        if len(self.E) < 1 << 15:
            ids = ids.astype(np.int16)  # which numpy sorts by radix
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        for k, d in enumerate((du[0], du[1], dn_all)):
            g.E[ids[head], k * n : (k + 1) * n] += _sums(np.take(d.reshape(-1, n), order, axis=0), head)
        self.seen += len(on)
        if self.seen >= UPDATE:
            self.descend(rate)
        return h_end

    def descend(self, rate: float) -> None:
        """One step by the gradient that has been added up, if any."""
        if not self.seen:
            return
        grad, scratch = self.grads.flat, self.scratch
        grad *= min(1.0 / self.seen, 1.0 / (float(np.sqrt(grad @ grad)) + 1e-9))
        self.t += 1
        self.m *= 0.9
        self.m += np.multiply(grad, np.float32(0.1), out=scratch)
        self.v *= 0.99
        np.multiply(grad, grad, out=scratch)
        self.v += np.multiply(scratch, np.float32(0.01), out=scratch)
        np.sqrt(self.v, out=scratch)
        scratch += 1e-7
        np.divide(self.m, scratch, out=scratch)
        scratch *= np.float32(rate * float(np.sqrt(1 - 0.99**self.t)) / (1 - 0.9**self.t))
        self.flat -= scratch
        grad[:], self.seen = 0, 0


def _far(weights: np.ndarray) -> bool:
    """Whether logits by these weights (states lie in -1 to 1, the last is 1) may leave what exp of 32-bit floats takes."""
    return not float(np.abs(weights).sum(axis=1).max()) < FAR


def _sums(rows: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sums of stretches of rows that begin at head."""
    return np.ascontiguousarray(np.add.reduceat(np.ascontiguousarray(rows.T), head, axis=1).T)


def lay_out(docs: list[np.ndarray], begin: int, lanes: int = LANES):
    """Documents side by side: (inputs, targets, live, fresh) of steps x lanes, and each one's place.

    begin is the input that stands for a document's begin.

    The longest go first, each to the shortest lane, so lanes end at about the same step.
    """
    total, longest = sum(map(len, docs)), max(map(len, docs))
    b = int(min(len(docs), max(64, min(lanes, total // longest)), lanes))
    heap, where, length = [(0, k) for k in range(b)], [(0, 0)] * len(docs), [0] * b
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        at, k = heapq.heappop(heap)
        where[d] = k, at
        length[k] = at + len(docs[d])
        heapq.heappush(heap, (length[k], k))
    rank = sorted(range(b), key=lambda k: -length[k])
    column = {k: i for i, k in enumerate(rank)}
    steps = max(length)
    x, y = np.zeros((b, steps), np.int32), np.zeros((b, steps), np.int32)
    fresh, live = np.zeros((b, steps), bool), np.zeros((b, steps), bool)
    for d, ids in enumerate(docs):
        k, at = column[where[d][0]], where[d][1]
        where[d] = k, at
        y[k, at : at + len(ids)] = ids
        x[k, at] = begin
        x[k, at + 1 : at + len(ids)] = ids[:-1]
        fresh[k, at] = True
        live[k, at : at + len(ids)] = True
    widths = live.sum(axis=0)  # lanes are sorted by length, so the live ones come first
    return x.T, y.T, live.T, fresh.T, where, widths


def _windows(widths: np.ndarray):
    """(first step, end, lanes) of scoring windows; where few lanes are left one has more steps, up to LANES * STEPS tokens."""
    at = 0
    while at < len(widths):
        n = int(widths[at])
        to = min(len(widths), at + STEPS * max(1, LANES // n))
        yield at, to, n
        at = to


def train(net: Net, docs: list[np.ndarray], rate: float = RATE) -> None:
    """Train on documents in spans of SPAN tokens, by windows of STEPS steps."""
    spans = [d[a : a + SPAN] for d in docs for a in range(0, len(d), SPAN)]
    if not spans:
        return
    x, y, live, fresh, _, widths = lay_out(spans, net.frequent + OTHER)
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    for a in range(0, len(widths), STEPS):
        b, n = min(len(widths), a + STEPS), int(widths[a])
        h[:n] = net.train_window(x[a:b, :n], y[a:b, :n], live[a:b, :n], fresh[a:b, :n], h[:n], rate)
    net.descend(rate)


def score_docs(net: Net, docs: list[np.ndarray]) -> np.ndarray:
    """Log10 of the network's part of each document's probability."""
    if not docs:
        return np.empty(0)
    x, y, live, fresh, where, widths = lay_out(docs, net.frequent + OTHER)
    h, out = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros(x.shape, np.float32)
    for a, b, n in _windows(widths):
        states, h[:n], _ = net.forward(x[a:b, :n], fresh[a:b, :n], h[:n])
        lp, _ = net.output(states[1:].reshape(-1, HIDDEN), np.ascontiguousarray(y[a:b, :n]).ravel())
        out[a:b, :n] = lp.reshape(b - a, n)
    lanes = np.ascontiguousarray(out.T)
    return np.array([lanes[k, at : at + len(d)].sum(dtype=np.float64) for d, (k, at) in zip(docs, where, strict=True)]) / np.log(10)


def by_length(coded: DataFrame) -> DataFrame:
    """The same rows, long texts in partitions of their own."""
    apart = coded.where(F.col("n_tokens") > LONG)
    return coded.where(F.col("n_tokens") <= LONG).union(apart.coalesce(max(1, apart.rdd.getNumPartitions() // TOGETHER)))


class _Coder:
    """Texts to numbers and network ids; what the dictionary alone gives is worked out once."""

    def __init__(self, voc: Vocabulary):
        self.frequent = voc.frequent
        self.words = pa.array(list(voc.words), pa.binary())
        ids = np.arange(len(voc.words), dtype=np.int32)
        ids[self.frequent :] = self.frequent + other_classes(self.words[self.frequent :])
        self.ids, self.logs = np.append(ids, 0).astype(np.int32), np.append(voc.log_count, 0.0)
        self.class_words = voc.class_words

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        """Columns CODED of the texts."""
        words, n = tokens(column)
        ends = np.cumsum(n)
        n = n + 1
        places = np.insert(np.arange(len(words)), ends, len(words))  # every text's words, then the end
        words = pa.concat_arrays([words, pa.array([END], pa.binary())])
        numbers = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1))[places]
        ids, logs, rest = self.ids[numbers], self.logs[numbers], np.flatnonzero(numbers < 0)
        rare = words.take(pa.array(places[rest]))
        ids[rest] = self.frequent + other_classes(rare)
        after = np.cumsum(n)
        first = after - n
        # A word of a class of others has its smoothed share of the class's training tokens.
        other = np.flatnonzero(ids >= self.frequent)
        parts = np.zeros(len(ids))
        parts[other] = logs[other] - self.class_words[ids[other] - self.frequent]
        of = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, np.append(0, after)).astype(np.int32)), rare)
        at = np.append(0, 4 * after).astype(np.int32)
        return [
            longs(n), longs(np.add.reduceat((numbers >= 0).astype(np.int64), first)), pa.array(np.add.reduceat(logs, first)), pa.array(np.add.reduceat(parts, first)),
            pc.binary_join(of, b" "), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(ids)]),
        ]


def count_words(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, cls int, c long): counts of all tokens of all texts."""

    def run(batches):
        def joined(held):
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def flush(c):
            for b in c.to_batches(400_000):
                yield pa.RecordBatch.from_arrays([b["word"], pa.array(other_classes(b["word"])), b["n"]], names=["word", "cls", "n"])

        held = []
        for b in batches:
            for piece in slices(b, 0, 32 << 20):
                words, n = tokens(piece.column(0))
                found = pc.value_counts(words)
                held += [pa.table({"word": found.field(0), "n": found.field(1)}), pa.table({"word": pa.array([END], pa.binary()), "n": longs([len(n)])})]
                if sum(map(len, held)) > 400_000:
                    held = [joined(held)]
                    if len(held[0]) > 400_000:
                        yield from flush(held.pop())
        if held:
            yield from flush(joined(held))

    rows = texts.select(text_col).mapInArrow(run, "word binary, cls int, n long")
    return rows.groupBy("word").agg(F.first("cls").alias("cls"), F.sum("n").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """About `most` words (word, c) of the highest counts, never more by more than chance, found without a sort.

    A histogram with eight steps to a power of two tells the step where they end; of its words a share
    drawn by hash fills up.
    """
    step = F.floor(F.log2("c") * 8).cast("int")
    left, last, share = most, 0, 1.0
    for last, n in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 8 rows to a power of two
        if n >= left:
            share = 0.99 * left / n if n > left else 1.0
            break
        left -= n
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    return counts.where((step > last) | (step == last) & drawn)


def learn_counts(training: DataFrame, text_col: str = "text") -> tuple[DataFrame, Vocabulary]:
    """The table of all counts, and the bounded part that workers hold."""
    counts = stage(count_words(training, text_col), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    most = max(KEEP, frequent(distinct))
    short = counts.where(F.length("word") <= LONGEST).select("word", "c")
    top = sorted(zip(*(c.to_pylist() for c in _most_frequent(short, most).toArrow().columns), strict=True), key=lambda x: (-x[1], x[0]))
    words = {w: k for k, (w, _) in enumerate(top)}
    c = np.array([n for _, n in top], np.float64)
    of, kinds = np.zeros(OTHER), np.zeros(OTHER)
    for cls, n, d in counts.groupBy("cls").agg(F.sum("c"), F.count(F.lit(1))).collect():  # OTHER rows
        of[cls], kinds[cls] = n, d
    for w, k in words.items():
        if k < frequent(distinct):
            of[other_class(w)] -= c[k]
            kinds[other_class(w)] -= 1
    return counts, Vocabulary(words, np.log10(c + 0.5), np.log10(of + 0.5 * (kinds + 1)), int(total), int(distinct))


def code(rows: DataFrame, voc, text_col: str = "text") -> DataFrame:
    """rows with CODED in the text's place: what the counts alone give, words out of the dictionary, and network ids.

    base_part and score_part are sums of log10 over dictionary words; ids are 32-bit.
    """
    at, schema = rows.columns.index(text_col), rows.drop(text_col).schema
    for c, kind in CODED:
        schema = schema.add(c, kind)

    def run(batches):
        coder = _Coder(voc.value)
        for whole in batches:
            for b in slices(whole, at):
                heads = [c for k, c in enumerate(b.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*heads, *coder(b.column(at))], names=schema.names)

    return rows.mapInArrow(run, schema)


CODED = (("n_tokens", "long"), ("n_dict", "long"), ("base_part", "double"), ("score_part", "double"), ("rare", "binary"), ("ids", "binary"))


def _pools(batches, column: int):
    """Lists of (batch, ids of its texts), about POOL tokens at a time."""
    pool, size = [], 0
    for b in batches:
        pool.append((b, [np.frombuffer(x.as_buffer(), np.int32) for x in b.column(column)]))
        size += sum(map(len, pool[-1][1]))
        if size >= POOL:
            yield pool
            pool, size = [], 0
    if pool:
        yield pool


def _train_shards(frequent: int, flat, rate: float):
    """(part, tokens, vector): means of parameters, weighted by tokens, over the shards of a partition; shards lie together."""

    def run(batches):
        def trained(docs):
            net = Net(frequent, flat.value)
            for a, b in itertools.pairwise([0, *_cuts(docs), len(docs)]):
                train(net, docs[a:b], rate)
            n = sum(map(len, docs))
            return n, net.flat.astype(np.float64) * n

        sums: dict[int, list] = {}

        def done():
            if docs:
                n, v = trained(docs)
                old = sums.setdefault(shard % GROUPS, [0, 0.0])
                old[0], old[1] = old[0] + n, old[1] + v

        shard, docs = None, []
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != shard:
                    done()
                    shard, docs = k, []
                docs.append(np.frombuffer(x.as_buffer(), np.int32))
        done()
        for part, (n, v) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), longs([n]), pa.array([(v / n).astype(np.float32).tobytes()], pa.binary())], names=["part", "tokens", "vector"])

    return run


def _cuts(docs: list[np.ndarray]) -> list[int]:
    """Places in docs after every POOL tokens or so."""
    done = np.cumsum([len(d) for d in docs]) // POOL
    return (np.flatnonzero(np.diff(done)) + 1).tolist()


def _mean(tokens: list[int], vectors: list[bytes]) -> np.ndarray:
    """The mean of float32 vectors by tokens; sorted first, so that it doesn't depend on the order of arrival."""
    total = 0.0
    for n, x in sorted(zip(tokens, vectors, strict=True)):
        total = total + np.frombuffer(x, np.float32).astype(np.float64) * n
    return (total / sum(tokens)).astype(np.float32)


def _joined(key, table):
    tokens = table.column("tokens").to_pylist()
    return pa.table({"tokens": longs([sum(tokens)]), "vector": pa.array([_mean(tokens, table.column("vector").to_pylist()).tobytes()], pa.binary())})


def _averaged(coded: DataFrame, frequent: int, flat: np.ndarray, rate: float, shards: int) -> np.ndarray:
    """Parameters after every shard of coded texts has trained a copy, averaged by tokens."""
    at = coded.sparkSession.sparkContext.broadcast(flat)
    dealt = coded.select("shard", "draw", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "draw", "ids").select("shard", "ids")
    rows = dealt.mapInArrow(_train_shards(frequent, at, rate), "part int, tokens long, vector binary")
    found = rows.groupBy("part").applyInArrow(_joined, "tokens long, vector binary").toArrow()  # GROUPS rows at most
    return _mean(*(c.to_pylist() for c in found.columns)) if found.num_rows else flat


def learn(training: DataFrame, voc: Vocabulary, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """The network's parameters after the start and all rounds over coded training texts (id, ids)."""
    shards = max(1, math.isqrt(max(0, tokens) // SHARD))
    drawn = training.select(F.xxhash64(F.col("id").cast("string"), "ids").alias("draw"), "ids")
    # About twice WARM rows pass the filter, so the one task that orders them holds no more.
    few = drawn.where(F.pmod("draw", F.lit(max(1, training.count()))) < 2 * WARM)
    flat = _averaged(few.orderBy("draw", "ids").limit(WARM).withColumn("shard", F.lit(0)), voc.frequent, start(voc), RATE, 1)
    place = drawn.withColumn("shard", F.pmod(F.shiftright("draw", 8), F.lit(shards)).cast("int"))
    for r in range(rounds):
        part = place.where(F.pmod(F.shiftright("draw", 40), F.lit(rounds)) == r)
        flat = _averaged(part, voc.frequent, flat, RATE / (2 + r), shards)
    return flat


def network_scores(coded: DataFrame, frequent: int, flat) -> DataFrame:
    """coded without ids, with the network's part of each text's log10 probability added to score_part."""
    at, schema = coded.columns.index("ids"), coded.drop("ids").schema
    part = schema.names.index("score_part")

    def run(batches):
        net = Net(frequent, flat.value)
        for pool in _pools(batches, at):
            found, done = score_docs(net, [d for _, ids in pool for d in ids]), 0
            for b, ids in pool:
                columns = [c for k, c in enumerate(b.columns) if k != at]
                columns[part] = pa.array(np.asarray(columns[part]) + found[done : done + len(ids)])
                done += len(ids)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return by_length(coded).mapInArrow(run, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Null and empty texts are an end alone; long texts are scored whole. An empty table gives an empty
    result, and a table without training rows gives scores under no counts. Repeated rows are scored one
    by one, alike; a null id is training data. Other columns of docs aren't read, whatever they are called.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    counts, voc = learn_counts(rows.where("not held_out"))
    coded = stage(code(rows, spark.sparkContext.broadcast(voc)), "coded-texts")
    flat = spark.sparkContext.broadcast(learn(coded.where("not held_out"), voc, voc.total))
    scored = network_scores(coded.drop("rare"), voc.frequent, flat)
    words = coded.where(F.length("rare") > 0).select("row", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("word"))
    found = words.join(counts.select(F.col("word").cast("string").alias("word"), "c"), "word", "left")
    sums = found.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.count("c").alias("n_rare"))
    out = scored.join(sums, "row", "left").withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    size = float(np.log10(voc.total + 0.5 * (voc.distinct + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_dict") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.col("logs") - F.col("n_tokens") * F.lit(size)).alias("base_score"), (F.col("score_part") + F.col("logs")).alias("score"),
    )
