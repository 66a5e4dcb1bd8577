"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit set where more than half of the XXH64 values (seed 42) of the text's
three-word shingles have it. Two fingerprints are linked at `radius` or fewer differing bits.

Distinct fingerprints are laid out in cells by the population counts of their four 16-bit quarters.
Two fingerprints that differ in r bits have quarter counts that differ by r in sum at most, so only
pairs of cells within that distance are compared; cells are split by hash into tiles of about
TILE fingerprints, and a pair of tiles is compared exactly by exclusive-or and bit counts in numpy.
Each tile returns a spanning forest of the links that it finds, never all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loamcast.llm.common import longs, restored, stage, texts_of, unused
from loamcast.llm.components import components

SHINGLE, SEED, RADIUS, TILE = 3, 42, 2, 4096
_BLOCK, _STEP = 1 << 20, 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text; a text without words has fingerprint zero."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < shingle:
        return digest(b" ".join(words), SEED)
    counts, total = np.zeros(64, np.int64), n - shingle + 1
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False)
        h = np.array([digest(b" ".join(g), SEED) for g in grams], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(id_col, *keep, fp long) for every row; null texts count as empty."""
    slim = docs.select(id_col, *keep, text_col)
    schema = slim.drop(text_col).schema.add("fp", "long")

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(x) for x in texts_of(b.column(b.num_columns - 1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], longs(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    return slim.mapInArrow(run, schema)


class _Forest:
    """A spanning forest of the pairs of one tile, folded in block by block; what is joined already is passed over."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            for x, y in zip(a[:_STEP].tolist(), b[:_STEP].tolist(), strict=True):
                if (p := self.find(x)) != (q := self.find(y)):
                    self.parent[max(p, q)] = min(p, q)
                    self.edges.append((x, y))
            a, b = a[_STEP:], b[_STEP:]
            if len(a):  # a dense tile: most of the rest hangs together by now
                nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = np.fromiter(map(self.find, nodes.tolist()), np.int64, len(nodes))[where]
                apart = root[: len(a)] != root[len(a) :]
                a, b = a[apart], b[apart]

    def take(self) -> list[tuple[int, int]]:
        out, self.edges, self.parent = self.edges, [], {}
        return out


def _matches(base: np.ndarray, other: np.ndarray, radius: int, own: bool):
    """Pairs within the radius, block by block; own: other is base, each pair once."""
    step = max(1, _BLOCK // max(1, len(base)))
    for at in range(0, len(other), step):
        part = other[at : at + step]
        i, j = np.nonzero(np.bitwise_count(base[:, None] ^ part[None, :]) <= radius)
        if own:
            ok = i < j + at
            i, j = i[ok], j[ok]
        if len(i):
            yield base[i].view(np.int64), part[j].view(np.int64)


def _compare(radius: int):
    def run(batches):
        key, base, done, forest, out = None, [], True, _Forest(), []

        def own():
            nonlocal base, done
            base, done = np.concatenate(base) if base else np.empty(0, np.uint64), True
            for a, b in _matches(base, base, radius, True):
                forest.add(a, b)

        for b in batches:
            k = np.asarray(b.column(0)) * np.int64(1 << 32) + np.asarray(b.column(1))
            kind, fp = np.asarray(b.column(2)), np.asarray(b.column(3)).view(np.uint64)
            cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(k)] if len(k) else []):
                if k[lo] != key:
                    if not done:
                        own()
                    out += forest.take()
                    key, base, done = k[lo], [], False
                if kind[lo] == 0:
                    base.append(fp[lo:hi])
                else:
                    if not done:
                        own()
                    for x, y in _matches(base, fp[lo:hi], radius, False):
                        forest.add(x, y)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([longs([x for x, _ in out]), longs([y for _, y in out])], names=["u", "v"])
                out = []
        if not done:
            own()
        out += forest.take()
        if out:
            yield pa.RecordBatch.from_arrays([longs([x for x, _ in out]), longs([y for _, y in out])], names=["u", "v"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the same distinct fingerprints as all links within the radius do."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    code = lambda q: ((q[0] * 17 + q[1]) * 17 + q[2]) * 17 + q[3]
    distinct = fps.select("fp", F.array(*quarter).alias("q")).withColumn("cell", code([F.col("q")[k] for k in range(4)]).cast("int"))
    # At most 17^4 cells exist, so their table is broadcast whatever the corpus holds.
    cells = distinct.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    moves = [m for m in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, m)) <= radius and m > (0, 0, 0, 0)]
    around = F.array(*(F.when(F.expr(" and ".join(f"q[{k}] + {d} between 0 and 16" for k, d in enumerate(m))), F.col("cell") + code(m)) for m in moves))
    placed = distinct.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    base = placed.select("cell", "tile", F.lit(0).alias("kind"), "fp")
    later = placed.where("tile + 1 < tiles").select("cell", F.explode(F.expr("sequence(tile + 1, tiles - 1)")).alias("tile"), F.lit(1).alias("kind"), "fp")
    near = distinct.select("fp", F.explode(F.filter(around, lambda x: x.isNotNull())).alias("cell")).join(F.broadcast(cells), "cell")
    near = near.select("cell", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), F.lit(1).alias("kind"), "fp")
    rows = base.union(later).union(near).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "kind")
    return rows.mapInArrow(_compare(radius), "u long, v long")


def _rooted(docs: DataFrame, radius: int, id_col: str, text_col: str, keep: tuple) -> DataFrame:
    """fingerprints() with component_id and the component's least fingerprint `root`."""
    rows = stage(fingerprints(docs, id_col, text_col, keep), "fingerprints")
    least = stage(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = stage(components(links(least.select("fp"), radius)), "fingerprint-roots")
    known = roots.select(F.col("node").alias("fp"), "root").join(least, "fp")
    whole = known.groupBy("root").agg(F.min("least").alias("component_id"))
    of = known.select("fp", "root").join(whole, "root").select("fp", "root", "component_id")
    every = least.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(stage(every, "fingerprint-components"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """(id_col, *keep, fp, component_id) for every row of docs; its other columns are not read.

    component_id is the least id reachable by links; null ids are passed over, so it is null only
    where all ids of a component are. Null and empty texts have no words; rows without words share
    fingerprint zero. Long texts are read whole. Repeated rows keep a row each. An empty table gives an
    empty result.
    """
    own = [id_col, *keep]
    slim = docs.select(*own, text_col).toDF(*(f"c{k}" for k in range(len(own))), "text")
    found = _rooted(slim, radius, "c0", "text", tuple(f"c{k}" for k in range(1, len(own))))
    return restored(found, own, "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each component: that with the least id (nulls last), then the first row.

    The columns are those of docs, whatever they are called; rows are as near_duplicates() sees them.
    """
    row = unused(docs, "row")
    keyed = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    slim = keyed.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    found = _rooted(slim, radius, "id", "text", ("row",))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("m"))
    kept = stage(first.select(F.col("m.row").alias(row)), "kept-rows")
    # Row numbers compress so well that their file's size would have them broadcast however many they are.
    return keyed.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
