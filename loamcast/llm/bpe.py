"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming UTF-8 decoding.

The merge ranks are compiled into a machine that reads a piece byte by byte. Two facts carry it: a
token sequence is the BPE encoding of its bytes exactly if every two neighbours are compatible (the
merges of their joined bytes give back these two), and the encoding of every prefix has a unique last
token. A state therefore is the set of open paths: trie positions of tokens under way, each with the
token before it. Reading a byte advances all paths and closes the one token that is compatible with
its predecessor. No path is open for longer than the longest token, so what all open paths agree on is
emitted after bounded lookahead. States are numbered by content and transitions are worked out on
first use. Pieces seen before come from a bounded cache.

Decoding joins token bytes; a table gives the UTF-8 state after each token from each state, so the
incremental machine runs per token, and only over stretches that split a character.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from loamcast.llm.common import holder, texts_of

#: Pieces and transitions remembered by a worker at most; beyond, the memory starts anew.
CACHE, TRANSITIONS = 250_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """BPE over one piece at a time; ranks give each token's id and merge priority."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.bits = max(ranks.values(), default=0).bit_length()
        self.low = (1 << self.bits) - 1
        self.compatible = functools.lru_cache(1 << 18)(self._compatible)
        kids: list[dict[int, int]] = [{}]
        token: list[int] = [-1]
        # Each token's halves; tokens that merging their own bytes doesn't give never arise in a piece.
        self.halves: dict[int, tuple[int, int]] = {}
        for t, i in ranks.items():
            if len(t) > 1:
                parts = self._merge(t, 2)
                if len(parts) != 2:
                    continue
                self.halves[i] = ranks[parts[0]], ranks[parts[1]]
            at = 0
            for b in t:
                if (to := kids[at].get(b)) is None:
                    to = kids[at][b] = len(kids)
                    kids.append({})
                    token.append(-1)
                at = to
            token[at] = i
        self.kids, self.token = kids, token
        self._reset()

    def _merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The definition: merge the adjacent pair of least rank, leftmost first, while over `least` are left."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged(self, piece: bytes) -> list[int]:
        return [self.ranks[p] for p in self._merge(piece)]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of a and b gives a and b.

        The tokens that touch the border grow in order of rank; the border falls if at some time their
        union has a lower rank than the next growth on either side (on the right side, an equal one:
        of equal pairs the leftmost merges first).
        """
        left, right = [a], [b]
        while (h := self.halves.get(left[-1])) is not None:
            left.append(h[1])
        while (h := self.halves.get(right[-1])) is not None:
            right.append(h[0])
        i, j, of, never = len(left) - 1, len(right) - 1, self.bytes_of, len(self.ranks) << 1
        while True:
            grow_a, grow_b = left[i - 1] if i else never, right[j - 1] if j else never
            across = self.ranks.get(of[left[i]] + of[right[j]])
            if across is not None and across < grow_a and across <= grow_b:
                return False
            if not i and not j:
                return True
            if grow_a <= grow_b:
                i -= 1
            else:
                j -= 1

    def _reset(self) -> None:
        # Flat: the token closed last, then node and token before it of each path.
        self.states: list[tuple] = [(-1,)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        #: (state, byte) to the next state and the token that closes, each packed in one number.
        self.moves: dict[int, int] = {}

    def _move(self, state: int, byte: int) -> int:
        """The state after a byte, and the token that ends the encoding of the prefix up to it."""
        kids, token = self.kids, self.token
        last, *paths = self.states[state]
        closed, out = -1, [-1]
        for node, before in (*zip(paths[::2], paths[1::2], strict=True), (0, last)):
            if (to := kids[node].get(byte)) is None:
                continue
            if closed < 0 and (t := token[to]) >= 0 and (before < 0 or self.compatible(before, t)):
                closed = t
            if kids[to]:
                out += (to, before)
        if closed < 0:
            raise ValueError("a byte without a token of its own")
        out[0] = closed
        key = tuple(out)
        if (n := self.number.get(key)) is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        return n << self.bits | closed

    def stream(self, piece: bytes):
        """Yield the ids of a piece in runs, each as soon as all open paths agree on it."""
        if (whole := self.ranks.get(piece)) is not None:
            yield [whole]
            return
        if len(self.moves) > TRANSITIONS:
            self._reset()
        state, moves, of, step, bits, low = 0, self.moves, self.bytes_of, 8 * self.longest, self.bits, self.low
        ends: list[int] = []  # for each byte since `begun`, the last token of the prefix up to it
        for at in range(0, len(piece), step):
            for b in piece[at : at + step]:
                if (m := moves.get(state << 8 | b)) is None:
                    m = moves[state << 8 | b] = self._move(state, b)
                state = m >> bits
                ends.append(m & low)
            if at + step >= len(piece):
                break
            # Open paths began within the longest token's reach; what leads to all these places is settled.
            chains = []
            for back in range(self.longest + 1):
                chain, k = [], len(ends) - back
                while k > 0:
                    chain.append(ends[k - 1])
                    k -= len(of[ends[k - 1]])
                chains.append(chain[::-1])
            common = 0
            for column in zip(*chains, strict=False):
                if any(x != column[0] for x in column):
                    break
                common += 1
            if common:
                yield chains[-1][:common]
                del ends[: sum(len(of[t]) for t in chains[-1][:common])]
        out, k = [], len(ends)
        while k > 0:
            out.append(ends[k - 1])
            k -= len(of[ends[k - 1]])
        yield out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if len(piece) > 8 * self.longest:
            return [t for run in self.stream(piece) for t in run]
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.moves) > TRANSITIONS:
            self._reset()
        state, moves, of, ends, out, bits, low = 0, self.moves, self.bytes_of, [], [], self.bits, self.low
        for b in piece:
            if (m := moves.get(state << 8 | b)) is None:
                m = moves[state << 8 | b] = self._move(state, b)
            state = m >> bits
            ends.append(m & low)
        k = len(ends)
        while k > 0:
            out.append(t := ends[k - 1])
            k -= len(of[t])
        out.reverse()
        return out


# UTF-8 states: 0 between characters; 1-3 so many continuation bytes to come; 4-7 the restricted second
# bytes after E0, ED, F0, F4; 8 an error.
_ERROR = 8


def _utf8_table() -> np.ndarray:
    t = np.full((9, 256), _ERROR, np.uint8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0] = 1
    t[0, 0xE1:0xF0] = 2
    t[0, 0xE0], t[0, 0xED] = 4, 5
    t[0, 0xF1:0xF4], t[0, 0xF0], t[0, 0xF4] = 3, 6, 7
    t[1, 0x80:0xC0], t[2, 0x80:0xC0], t[3, 0x80:0xC0] = 0, 1, 2
    t[4, 0xA0:0xC0], t[5, 0x80:0xA0] = 1, 1
    t[6, 0x90:0xC0], t[7, 0x80:0x90] = 2, 2
    return t


class Utf8Machine:
    """Incremental UTF-8 checking: state in, bytes or tokens, state out; state 8 is an error."""

    table = _utf8_table()

    @classmethod
    def feed(cls, state: int, data: bytes) -> int:
        t = cls.table
        for b in data:
            state = int(t[state, b])
        return state


class Decoder:
    """Token ids to bytes, checked as UTF-8 while they stream."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        self.after = np.full((9, size), _ERROR, np.uint8)
        for t, i in ranks.items():
            self.tokens[i] = t
        longest = max(map(len, ranks), default=0)
        padded = np.zeros((size, longest), np.uint8)
        length = np.array([len(t) for t in self.tokens], np.int64)
        for i, t in enumerate(self.tokens):
            padded[i, : len(t)] = np.frombuffer(t, np.uint8)
        for s in range(9):
            state = np.full(size, s, np.uint8)
            for k in range(longest):
                live = length > k
                state[live] = Utf8Machine.table[state[live], padded[live, k]]
            self.after[s] = state

    def step(self, state: int, ids: np.ndarray) -> tuple[bytes, int]:
        """Bytes of the next ids of a stream, and the UTF-8 state after them."""
        data = b"".join(map(self.tokens.__getitem__, ids.tolist()))
        odd = np.flatnonzero(self.after[0][ids])  # tokens that don't lead from state 0 to state 0
        at, n = 0, len(ids)
        while at < n:
            if state == 0:
                k = int(np.searchsorted(odd, at))
                if k == len(odd):
                    break
                at = int(odd[k])
            state = int(self.after[state, ids[at]])
            at += 1
            if state == _ERROR:
                break
        return data, state


class Tokenizer:
    """Regex pieces, each encoded on its own, with a bounded cache of pieces."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = load_ranks(ranks_path)
        self.machine = Transducer(self.ranks)
        self.decoder = Decoder(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.seen: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as unsigned 32-bit integers."""
        seen, out = self.seen, bytearray()
        for piece in self.pieces(text):
            ids = seen.get(piece)
            if ids is None:
                if len(seen) >= CACHE:
                    seen.clear()
                ids = array("I", self.machine.encode(piece.encode("utf-8"))).tobytes()
                if len(piece) <= 64:
                    seen[piece] = ids
            out += ids
        return np.frombuffer(bytes(out), np.uint32)


@functools.lru_cache(2)
def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    """One per worker process: it is compiled once, and its transitions grow with use."""
    return Tokenizer(ranks_path, pattern)


holder(tokenizer.cache_clear)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row; null and empty texts have no ids."""
    schema = docs.select(id_col).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        t = tokenizer(ranks_path, pattern)
        for b in batches:
            ids = [t.encode(x.decode("utf-8", "replace")).astype(np.int32) for x in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary, valid boolean) for every row of token ids; null ids count as none."""
    schema = tokens.select(id_col).schema.add("decoded", "binary").add("valid", "boolean")

    def run(batches):
        d = tokenizer(ranks_path, pattern).decoder
        for b in batches:
            found = [d.step(0, np.asarray(x if x is not None else [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.binary()), pa.array([s == 0 for _, s in found])], names=schema.names)

    return tokens.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256, valid): texts encoded and their ids decoded.

    Ids are hashed as little-endian unsigned 32-bit integers. The ids of a text are decoded in blocks,
    with the UTF-8 state carried over.
    """
    schema = docs.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("valid", "boolean")

    def run(batches):
        t = tokenizer(ranks_path, pattern)
        for b in batches:
            rows = []
            for x in texts_of(b.column(1)):
                ids = t.encode(x.decode("utf-8", "replace")).astype("<u4", copy=False)
                h, state = hashlib.sha256(), 0
                for at in range(0, len(ids), 1 << 16):
                    data, state = t.decoder.step(state, ids[at : at + (1 << 16)])
                    h.update(data)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), h.hexdigest(), state == 0))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
