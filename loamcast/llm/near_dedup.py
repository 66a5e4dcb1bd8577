"""Near-duplicates by the Jaccard similarity of word shingles: SimHash by tiled comparison, or a prefix filter.

Texts are sets of the XXH64 values (seed 42) of their five-word shingles; two are linked where they
share four fifths of their union or more. Equal sets are one node.

simhash_keep_one() compares the wide fingerprints of all sets whose sizes let them be linked, in tiles
of cells of like sizes; the whole sets of pairs within RADIUS settle whether they are links. A tile
returns a spanning forest of its pairs, then each group that these leave in parts is compared with the set
nearest to all others, and sets still in parts of one group are compared whole in tiles of their own.
Its work grows with the square of the sets of like sizes; keep_one() finds the same links by equi-joins.

keep_one(): of n values, ordered alike for all
sets, a set's first n - ceil(4n/5) + 1 must meet those of every set that it is linked to (prefix
filter), so sets meet by these values in equi-joins and no pair that could be linked is passed over.
Any order does; values that many texts of a sample share come last, so that a passage which a large part
of the corpus holds brings few sets together.

Sets that met are compared by wide SimHash fingerprints (exclusive-or and bit counts) first: RADIUS is
so far beyond what linked sets differ by that one link in about 10^9 is lost. What is left is settled by
the whole sets. Groups that share a value are never spelled out as pairs: each is compared with one pivot
(the least row), then with the set whose values most sets hold (of copies with words changed here and
there the text that they come from), and only sets that are still in components apart are compared with each other, in tiles. Pairs within a component can't change it.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from loamcast.llm.common import StageTable, longs, make_room, release, slices, texts_of, unused
from loamcast.llm.components import components
from loamcast.llm.simhash import _Forest

#: Linked where overlap / union >= PART / WHOLE.
SHINGLE, SEED, PART, WHOLE = 5, 42, 4, 5
#: 64-bit words of a fingerprint, and the differing bits up to which sets are compared as a whole. A bit of
#: linked sets differs with a chance of 0.19 at most (five shingles against four; 0.15 for long texts), so of
#: 256 bits 88 or fewer do but for one pair in about 10^9.
FP_WORDS, RADIUS = 4, 88
#: The same for sets of LONG values or more, of whose bits 0.165 at most differ by chance.
LONG, RADIUS_LONG = 40, 78
#: Bits that may differ in the first half of a fingerprint (sets of LONG values or more: HALF_LONG); of linked
#: sets more do in fewer than one pair in 10^10. The other half is compared where no more do.
HALF, HALF_LONG = 56, 52
#: Cells of sizes to a factor of WHOLE / PART, by which the sizes of linked sets differ at most; the sets of
#: a cell that are held as one tile, and their bytes where whole sets are compared.
STEPS, CELL_TILE, CELL_BYTES = 8, 1 << 15, 4 << 20
#: Values are put last if texts of the sample (one in EVERY) hold them OFTEN times or more, the COMMON most
#: frequent of them; this only orders values, and any other choice gives the same links.
EVERY, OFTEN, COMMON = 16, 4, 1 << 18
#: Sets of one value that are compared as a block.
TILE = 4096
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct values of a text's shingles in order; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    grams = zip(*(words[k:] for k in range(SHINGLE)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64, len(words) - SHINGLE + 1))


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """FP_WORDS words; a bit is set where more than half of the values' mixed forms have it."""
    counts = np.zeros((FP_WORDS, 64), np.int64)
    for at in range(0, len(s), 1 << 14):
        part = s[at : at + (1 << 14)]
        mixed = [part]
        for m in _MIX:
            x = part * np.uint64(m)
            x ^= x >> np.uint64(31)
            x *= np.uint64(m ^ 0x5555555555555554)
            x ^= x >> np.uint64(29)
            mixed.append(x)
        for k, x in enumerate(mixed):
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(s), axis=1, bitorder="little").view(np.uint64).ravel()


def pack(s: np.ndarray) -> bytes:
    """The upper halves of a set's values, which settle its overlap with others."""
    return (s >> np.uint64(32)).astype(np.uint32).tobytes()


def prefix_of(s: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The values by which a set meets others: its first ones, with `common` (sorted) last in order of `rank`."""
    n = len(s)
    size = n - -(-PART * n // WHOLE) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        late = np.where(common[at] == s, rank[at], 0)
        if late.any():
            s = s[np.lexsort((s, late))]
    return s[:size]


def _describe(common=None):
    """(..., digest, n, prefix, fp, s) in the text's place; prefixes are empty without common values."""

    def run(batches):
        make_room()
        values, rank = common.value if common else (None, None)
        for whole in batches:
            for b in slices(whole, whole.num_columns - 1, 2 << 20):
                digests, sizes, parts, fps, packed = [], [], [], [], []
                for x in texts_of(b.column(b.num_columns - 1)):
                    s = shingle_set(x)
                    digests.append(hashlib.md5(s.tobytes()).digest())
                    sizes.append(len(s))
                    parts.append(prefix_of(s, values, rank).view(np.int64) if common else np.empty(0, np.int64))
                    fps.append(wide_fingerprint(s).tobytes())
                    packed.append(pack(s))
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), longs(np.concatenate(parts) if parts else []))
                new = [pa.array(digests, pa.binary()), longs(sizes), prefix, pa.array(fps, pa.binary()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], "digest", "n", "prefix", "fp", "s"])

    return run


def _values(batches):
    for b in batches:
        for x in texts_of(b.column(0)):
            yield pa.RecordBatch.from_arrays([longs(shingle_set(x).view(np.int64))], names=["value"])


def common_values(texts: DataFrame, every: int = EVERY, often: int = OFTEN, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The values that many texts of a sample share, sorted, and their ranks (1: least frequent)."""
    counts = texts.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text").mapInArrow(_values, "value long").groupBy("value").count()
    held = StageTable(counts.where(F.col("count") >= often), "common-values")
    floor = often - 1
    # The least count of which `most` values at most are left, from a histogram of a few rows per power of two.
    step = F.floor(F.log2("count") * 8).alias("step")
    steps, left = held.df.groupBy(step).agg(F.count(F.lit(1)), F.max("count")).orderBy(F.desc("step")).collect(), 0
    for _, n, top in steps:
        left += n
        if left > most:
            floor = top
            break
    found = held.df.where(F.col("count") > floor).toArrow()  # `most` rows at most
    held.drop()
    value, n = (np.asarray(found.column(k).combine_chunks()) if found.num_rows else np.empty(0, np.int64) for k in range(2))
    value = value.view(np.uint64)
    order = np.argsort(value)
    return value[order], n[order]


def _near(batches):
    """The pairs (u, v) whose fingerprints (fu, fv) lie within RADIUS."""
    for b in batches:
        f = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, FP_WORDS) for k in (2, 3)]
        ok = np.bitwise_count(f[0] ^ f[1]).sum(axis=1, dtype=np.int32) <= RADIUS
        yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _similar(batches):
    """The pairs (u, v) whose sets (su, sv) are linked."""
    for b in batches:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = np.sort(np.concatenate([x, y]))
            same = int((both[1:] == both[:-1]).sum())
            ok.append(WHOLE * same >= PART * (len(both) - same))
        yield pa.RecordBatch.from_arrays(b.columns[:2], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _across(batches):
    """Pairs of a value's sets in components apart that lie within RADIUS; kind 0 rows of a tile come first."""
    make_room()
    step = 1 << 18
    key, base = None, None

    def close(x, y):
        rx, cx, nx, px, fx = x
        ry, cy, ny, py, fy = y
        for at in range(0, len(ry), max(1, step // max(1, len(rx)))):
            part = slice(at, at + max(1, step // max(1, len(rx))))
            d = np.zeros((len(rx), len(ry[part])), np.uint16)
            for k in range(FP_WORDS):
                d += np.bitwise_count(fx[:, None, k] ^ fy[None, part, k])
            i, j = np.nonzero((d <= RADIUS) & (cx[:, None] != cy[None, part]))
            n, m, left = nx[i], ny[part][j], np.minimum(nx[i] - px[i], ny[part][j] - py[part][j])
            ok = ((WHOLE + PART) * left >= PART * (n + m)) & (d[i, j] <= np.where(np.minimum(n, m) < LONG, RADIUS, RADIUS_LONG))
            i, j = i[ok], j[ok]
            if len(i):
                a, b = rx[i], ry[part][j]
                yield np.minimum(a, b), np.maximum(a, b)

    held, kinds = [], []

    def done():
        nonlocal held, kinds, base
        rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
        found = []
        if kinds[0] == 0:  # a tile's own rows
            base = rows
            found = [(a[a < b], b[a < b]) for a, b in close(rows, rows)]
        elif base is not None:
            found = list(close(base, rows))
        held, kinds = [], []
        if found:
            pairs = np.unique(np.stack([np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])]), axis=1)
            return pa.RecordBatch.from_arrays([longs(pairs[0]), longs(pairs[1])], names=["u", "v"])

    for b in batches:
        k = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in range(3)])
        fp = np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint64).reshape(-1, FP_WORDS)
        cuts = np.flatnonzero((np.diff(k, axis=1) != 0).any(axis=0)) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(fp)] if len(fp) else []):
            now = tuple(k[:, lo].tolist())
            if now != key or now[2] and sum(len(h[0]) for h in held) >= 2 * TILE:
                if held and (out := done()):
                    yield out
                if key is None or now[:2] != key[:2]:
                    base = None
                key = now
            held.append((*(np.asarray(b.column(c))[lo:hi] for c in range(3, 7)), fp[lo:hi]))
            kinds.append(now[2])
    if held and (out := done()):
        yield out


def _close(x, y):
    """Blocks (i, j, spare) of places in the sets x and y, each (rep, root, n, fp by words, ...), that can be linked.

    Their fingerprints lie within the radius, by `spare` bits; pairs of one root are left out. Of a tile's own
    rows (y is x) each pair comes once.
    """
    (cx, nx, fx), (cy, ny, fy) = x[1:4], y[1:4]
    if not len(nx) or not len(ny):
        return
    wide, step, front = 1 << 12, 16, FP_WORDS // 2
    half = HALF_LONG if min(nx.min(), ny.min()) >= LONG else HALF
    bits = np.empty((step, wide), np.uint64)
    counts = [np.empty((step, wide), np.uint8) for _ in range(2)]
    for lo in range(0, len(nx), wide):
        hi = min(lo + wide, len(nx))
        for at in range(lo // step * step if y is x else 0, len(ny), step):
            to = min(at + step, len(ny))
            b, d, more = (a[: to - at, : hi - lo] for a in (bits, *counts))
            for k in range(front):
                np.bitwise_xor(fy[k, at:to, None], fx[k, None, lo:hi], out=b)
                np.bitwise_count(b, out=more if k else d)
                if k:
                    d += more
            j, i = np.nonzero(d <= half)
            if not len(i):
                continue
            apart = d[j, i].astype(np.int64)
            i, j = i + lo, j + at
            for k in range(front, FP_WORDS):
                apart += np.bitwise_count(fx[k, i] ^ fy[k, j])
            n, m = nx[i], ny[j]
            spare = np.where(np.minimum(n, m) < LONG, RADIUS, RADIUS_LONG) - apart
            most = np.minimum(n, m) - (n == m)  # values that different sets can share
            ok = (spare >= 0) & (WHOLE * most >= PART * (n + m - most)) & (cx[i] != cy[j])
            if y is x:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok], spare[ok]


class _Overlaps:
    """How many values sets share with those of a tile, from the places of a tile's values among its distinct ones."""

    def __init__(self, packed: list[bytes]):
        self.ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
        self.values, self.at = np.unique(np.frombuffer(b"".join(packed), np.uint32), return_inverse=True)
        self.held = np.zeros(len(self.values), np.uint8)

    def of(self, packed: bytes, rows: np.ndarray) -> np.ndarray:
        x = np.frombuffer(packed, np.uint32)
        at = np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)
        at = at[self.values[at] == x]
        starts, sizes = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
        edges = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) + np.repeat(starts - edges, sizes)
        self.held[at] = 1
        same = np.add.reduceat(self.held[self.at[places]], edges, dtype=np.int64)
        self.held[at] = 0
        return same


def _batch(u, v, weight):
    return pa.RecordBatch.from_arrays([longs(np.minimum(u, v)), longs(np.maximum(u, v)), longs(weight)], names=["u", "v", "weight"])


class _Near:
    """A tile's rows (rep, root, n, fp); a forest of the pairs that _close() finds, and (u, u, sum of 1 + spare)."""

    def __init__(self, base):
        self.base, self.weight, self.forest = base, np.zeros(len(base[0]), np.int64), _Forest()

    def heavy(self, rep, weight):
        at = np.flatnonzero(weight)
        if len(at):
            yield _batch(rep[at], rep[at], weight[at])

    def meet(self, other):
        weight = self.weight if other is self.base else np.zeros(len(other[0]), np.int64)
        for i, j, spare in _close(self.base, other):
            self.forest.add(self.base[0][i], other[0][j])
            np.add.at(self.weight, i, spare + 1)
            np.add.at(weight, j, spare + 1)
        if other is not self.base:
            yield from self.heavy(other[0], weight)

    def finish(self):
        yield from self.heavy(self.base[0], self.weight)
        if edges := self.forest.take():
            u, v = np.array(edges, np.int64).T
            yield _batch(u, v, np.zeros(len(u), np.int64))


class _Linked:
    """A tile's rows (rep, root, n, fp, s); links that join the roots which all links of pairs of _close() join."""

    def __init__(self, base):
        self.base, self.label, self.forest = base, base[1].copy(), _Forest()
        self.overlaps = _Overlaps(base[4].tolist())

    def meet(self, other):
        rep, _, n, _, _ = self.base
        for i, j, _ in _close(self.base, other):
            u, v = [], []
            cuts = np.flatnonzero(np.diff(j)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(j)]):
                k, rows, own = j[lo], i[lo:hi], self.forest.find(int(other[1][j[lo]]))
                rows = rows[self.label[rows] != own]
                if not len(rows):
                    continue
                same = self.overlaps.of(other[4][k], rows)
                rows = rows[WHOLE * same >= PART * (n[rows] + other[2][k] - same)]
                labels, first = np.unique(self.label[rows], return_index=True)
                for x in labels.tolist():
                    self.forest.parent[x] = own
                    self.label[self.label == x] = own
                u += rep[rows[first]].tolist()
                v += [int(other[0][k])] * len(first)
            if u:
                yield _batch(np.array(u), np.array(v), np.zeros(len(u), np.int64))

    def finish(self):
        return ()


def _compare(whole: bool):
    """What _Near (whole: _Linked) finds in each tile; its own rows, kind 0, come first."""

    def run(batches):
        make_room()
        key, held, tile = None, [], None

        def ready():
            nonlocal held, tile
            base, held = tuple(np.concatenate(c, axis=-1) for c in zip(*held, strict=True)), []
            tile = (_Linked if whole else _Near)(base)
            yield from tile.meet(base)

        def finish():
            nonlocal tile
            if held:
                yield from ready()
            if tile:
                yield from tile.finish()
            tile = None

        for b in batches:
            k = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in range(3)])
            columns = [np.asarray(b.column(c)) for c in range(3, 6)]
            columns.append(np.ascontiguousarray(np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64).reshape(-1, FP_WORDS).T))
            if whole:
                columns.append(np.array([*b.column(7).to_pylist(), None], object)[:-1])
            cuts = np.flatnonzero((np.diff(k, axis=1) != 0).any(axis=0)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), b.num_rows] if b.num_rows else []):
                now, kind = (k[0, lo], k[1, lo]), k[2, lo]
                if now != key:
                    yield from finish()
                    key = now
                rows = tuple(c[..., lo:hi] for c in columns)
                if kind == 0:
                    held.append(rows)
                    continue
                if held:
                    yield from ready()
                if tile:
                    yield from tile.meet(rows)
        yield from finish()

    return run


def _may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of n and m values whose first common one is in places pos and at can still be linked."""
    return (WHOLE + PART) * F.least(n - pos, m - at) >= PART * (n + m)


class _Links:
    """The links between sets (rep, n, prefix, fp, s); each step's tables are deleted once they are read."""

    def __init__(self, sets: DataFrame, tile: int = TILE):
        self.sets, self.tile, self.tables = sets, tile, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(StageTable(df, name))
        release(df.sparkSession)
        return self.tables[-1].df

    def drop(self) -> None:
        for t in self.tables:
            t.drop()
        self.tables = []

    def checked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are links; sets of pairs within RADIUS alone are read."""
        side = lambda k, c: self.sets.select(F.col("rep").alias(k), F.col(c).alias(c + k)).hint("merge")
        with_fp = pairs.join(side("u", "fp"), "u").join(side("v", "fp"), "v").select("u", "v", "fpu", "fpv")
        return self.verified(self.stage(with_fp.mapInArrow(_near, "u long, v long"), "near-pairs"))

    def verified(self, near: DataFrame) -> DataFrame:
        """The pairs (u, v) of a staged table that are links."""
        members = near.select(F.col("u").alias("rep")).union(near.select(F.col("v").alias("rep"))).distinct()
        whole = self.stage(self.sets.select("rep", "s").join(members.hint("merge"), "rep", "left_semi"), "shingle-sets")
        of = lambda k: whole.select(F.col("rep").alias(k), F.col("s").alias(f"s{k}")).hint("merge")
        both = near.join(of("u"), "u").join(of("v"), "v").select("u", "v", "su", "sv")
        return self.stage(both.mapInArrow(_similar, "u long, v long"), "links")

    def star(self, rows: DataFrame) -> DataFrame:
        """Links of every set with the pivots `m` that it met."""
        met = rows.where((F.col("rep") != F.col("m.rep")) & _may_link(F.col("n"), F.col("pos"), F.col("m.n"), F.col("m.pos")))
        return self.checked(met.select(F.least("rep", "m.rep").alias("u"), F.greatest("rep", "m.rep").alias("v")).distinct())

    def known(self, links: DataFrame) -> DataFrame:
        return self.stage(components(links).select(F.col("node").alias("rep"), "root"), "known-components")

    def apart(self, shared: DataFrame, links: DataFrame, pivot: bool) -> DataFrame:
        """shared with the components so far; values whose sets are all in one component are left out."""
        roots = self.known(links)
        at = shared.select("value", "rep", "n", "pos").join(roots.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        if pivot:
            at = at.join(shared.groupBy("rep").agg(F.sum("held").alias("weight")).hint("merge"), "rep")
        met = Window.partitionBy("value")
        at = at.withColumns({"lo": F.min("root").over(met), "hi": F.max("root").over(met)})
        if pivot:
            at = at.withColumn("m", F.min(F.struct(-F.col("weight"), "rep", "n", "pos")).over(met)).drop("weight")
        return self.stage(at.where("lo < hi").drop("lo", "hi"), "values-apart")

    def across(self, rows: DataFrame) -> DataFrame:
        """Links between sets of a value that are in components apart, each value in tiles of about TILE sets."""
        tiles = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("value")) / self.tile).cast("int")
        placed = rows.select("value", "rep", "root", "n", "pos", tiles.alias("tiles")).join(self.sets.select("rep", "fp").hint("merge"), "rep")
        placed = self.stage(placed.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")), "tiles")
        own = placed.select("value", "tile", F.lit(0).alias("kind"), "rep", "root", "n", "pos", "fp")
        later = placed.where("tile > 0").select("value", F.explode(F.expr("sequence(0, tile - 1)")).alias("tile"), F.lit(1).alias("kind"), "rep", "root", "n", "pos", "fp")
        dealt = own.union(later).repartition("value", "tile").sortWithinPartitions("value", "tile", "kind")
        return self.checked(dealt.mapInArrow(_across, "u long, v long").distinct())

    def find(self) -> DataFrame:
        places = self.sets.select("rep", "n", F.posexplode("prefix").alias("pos", "value"))
        met = Window.partitionBy("value")
        places = places.withColumns({"held": F.count(F.lit(1)).over(met), "m": F.min(F.struct("rep", "n", "pos")).over(met)})
        shared = self.stage(places.where("held > 1").select("rep", "n", "pos", "value", "held", "m"), "shared-shingles")
        del places  # or its shuffle files would stay
        release(shared.sparkSession)
        links = self.star(shared)
        rows = self.apart(shared, links, True)
        links = self.stage(links.union(self.star(rows)), "star-links")
        return links.union(self.across(self.apart(rows, links, False)))


class _ByFingerprints(_Links):
    """Links between sets (rep, n, fp, s), found by SimHash fingerprints."""

    def tiled(self, sets: DataFrame, whole: bool = False) -> DataFrame:
        """(u, v, weight) by _compare() of the sets (rep, root, n, fp, whole: s), each two of like sizes in one tile."""
        own = sets.withColumn("cell", F.floor(F.log("n") * (STEPS / math.log(WHOLE / PART))).cast("int"))
        tiles = F.count(F.lit(1)) / self.tile
        if whole:
            tiles = F.greatest(tiles, F.sum(F.length("s")) / CELL_BYTES)
        # Cells are few whatever the corpus holds, as each takes in three percent more words.
        cells = F.broadcast(own.groupBy("cell").agg(F.ceil(tiles).cast("int").alias("tiles")))
        row = ("rep", "root", "n", "fp", "s") if whole else ("rep", "root", "n", "fp")
        placed = own.join(cells, "cell").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        base = placed.select("cell", "tile", F.lit(0).alias("kind"), *row)
        later = placed.where("tile + 1 < tiles").select("cell", F.explode(F.expr("sequence(tile + 1, tiles - 1)")).alias("tile"), F.lit(1).alias("kind"), *row)
        # Sets meet those of up to a fourth less; one cell more, as logarithms are rounded.
        lower = own.select(F.explode(F.expr(f"sequence(cell - {STEPS + 1}, cell - 1)")).alias("cell"), *row).join(cells, "cell")
        lower = lower.select("cell", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.lit(1).alias("kind"), *row)
        dealt = base.union(later).union(lower).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "kind")
        return dealt.mapInArrow(_compare(whole), "u long, v long, weight long")

    def parts(self, groups: DataFrame, links: DataFrame) -> DataFrame:
        """The sets (rep, group) with their components `root` so far; groups of one component or two sets are left out."""
        at = groups.select("rep", "group").join(self.known(links).hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        apart = at.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("sets")).where("lo < hi and sets > 2").select("group")
        return self.stage(at.join(apart.hint("merge"), "group"), "groups-apart")

    def find(self) -> DataFrame:
        # Different sets of fewer values are never linked.
        able = self.sets.where((WHOLE - PART) * F.col("n") >= PART).select("rep", "n", "fp")
        met = self.stage(self.tiled(able.withColumn("root", F.col("rep"))), "near-fingerprints")
        edges = met.where("u != v").select("u", "v")
        links = self.verified(edges)
        # Pairs that no forest lists are within the groups that the listed ones make.
        groups = self.stage(components(edges).select(F.col("node").alias("rep"), F.col("root").alias("group")), "near-groups")
        rows = self.parts(groups, links)
        weight = met.where("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("weight").alias("weight"))
        pivots = rows.join(weight.hint("merge"), "rep").groupBy("group").agg(F.min(F.struct(-F.col("weight"), "rep", "root")).alias("m"))
        star = rows.join(pivots.hint("merge"), "group").where(F.col("root") != F.col("m.root"))
        star = star.select(F.least("rep", "m.rep").alias("u"), F.greatest("rep", "m.rep").alias("v"))
        links = self.stage(links.union(self.verified(self.stage(star, "star-pairs"))), "star-links")
        left = self.parts(rows, links).select("rep", "root").join(self.sets.select("rep", "n", "fp", "s").hint("merge"), "rep")
        return links.union(self.tiled(self.stage(left, "whole-sets"), True).select("u", "v"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """The rows of docs, one of each component: that with the least id (nulls last), then the first row.

    Null texts count as empty; texts without words are equal, and long texts are read whole. Repeated
    rows are copies like others. An empty table gives an empty result. Columns of docs keep their names
    whatever these are.
    """
    return _kept(docs, id_col, text_col, tile, False)


def simhash_keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = CELL_TILE) -> DataFrame:
    """keep_one() with links found by comparing SimHash fingerprints."""
    return _kept(docs, id_col, text_col, tile, True)


def _kept(docs: DataFrame, id_col: str, text_col: str, tile: int, by_fingerprints: bool) -> DataFrame:
    row = unused(docs, "row")
    # Row numbers depend on the plan below them, which differs with the columns that a reader asks for.
    keyed = StageTable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows").df
    slim = keyed.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = slim.drop("text").schema.add("digest", "binary").add("n", "long").add("prefix", ArrayType(LongType())).add("fp", "binary").add("s", "binary")
    common = None if by_fingerprints else docs.sparkSession.sparkContext.broadcast(common_values(slim))
    rows = slim.mapInArrow(_describe(common), schema)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best")
    same = rows.groupBy("digest").agg(F.min("row").alias("rep"), best, *(F.first(c).alias(c) for c in ("n", "prefix", "fp", "s")))
    sets = StageTable(same.drop("digest"), "distinct-sets")
    del same, rows  # or their shuffle files would stay
    release(docs.sparkSession)
    found = (_ByFingerprints if by_fingerprints else _Links)(sets.df, tile)
    roots = StageTable(components(found.find()), "near-components")
    found.drop()
    group = sets.df.select("rep", "best").join(roots.df.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    first = group.groupBy(F.coalesce("root", "rep").alias("g")).agg(F.min("best").alias("m"))
    kept = StageTable(first.select(F.col("m.row").alias(row)), "kept-rows").df
    sets.drop()
    roots.drop()
    release(docs.sparkSession)
    # Row numbers compress so well that their file's size would have them broadcast however many they are.
    return keyed.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
