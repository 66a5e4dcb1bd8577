"""Exact top-k inner products by dual-tree cover-tree search.

Vectors become integers floor(scale * x). A net of at most PIVOTS far-apart vectors, taken from a bounded
sample, deals every vector to the cell of its nearest pivot; a cell's vectors form blocks of about BLOCK,
and each block gets a cover tree. Queries first search a block of their own cell, which gives each a kth
score; they then go to the blocks of those cells alone in which the cell's radius leaves room for it.
Candidates are shuffled once in either pass and a block's tree is built once, whatever the queries.

In a block, queries come in groups with cover trees of their own, and two trees are walked together: for
centres a, b and covering radii r, s no product in a pair of nodes exceeds <a,b> + r|b| + s|a| + rs, so a
pair goes once that is below the worst kth score of the query node. Leaves are scored exactly.

A cover tree has levels of halving scale: centres of a level are vectors, further apart than its scale;
every centre is one on all lower levels (nesting) and lies within the scale of its parent's level
(covering). Where vectors have no clusters, as uniform ones of many dimensions, nothing can be pruned and
a tree has little but a root and leaves: the search is then an exact comparison in blocks. report() gives
the share of pairs that were pruned.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loamcast.llm.common import longs, stage

SCALE, TOP, EVERY = 256, 5, 50
#: Vectors of a block of candidates and of a group of queries, about; vectors of a leaf, about: of more siblings
#: small ones are put together with their nearest, so that a pair of leaves is worth a product of matrices.
#: A node of FEW vectors is a leaf.
BLOCK, QUERIES, LEAF, FEW = 4096, 1024, 64, 8
#: Pivots at most, and vectors of the sample for each.
PIVOTS, SAMPLE = 1024, 16
_EXACT = float(1 << 52)


class Node(NamedTuple):
    """A cover-tree node: its centre's row, the radius that covers all its rows, and children or rows of a leaf."""

    centre: int
    radius: float
    level: int
    rows: np.ndarray  # all rows below
    children: tuple


def build(x: np.ndarray) -> Node:
    """Cover tree over rows of x (float64)."""
    n = len(x)
    square = (x * x).sum(axis=1)
    # A rounding error of the squared distance must not make a covered row look uncovered.
    slack = 1e-9 * (1 + float(square.max(initial=0)))
    far = lambda c: np.sqrt(np.maximum(square + square[c] - 2 * (x @ x[c]), 0) + slack)
    near, owner = far(0), np.zeros(n, np.int64)
    top = float(near.max())
    levels, scale, centres = [], top, [0]  # per level: scale, centres, their parents on the level above
    parents = {0: 0}
    levels.append((centres[:], dict(parents)))
    least = np.sqrt(slack) * 2
    while scale > least:
        scale /= 2
        above, parents = owner.copy(), {c: c for c in centres}
        while len(left := np.flatnonzero(near > scale)):
            c = int(left[np.argmax(near[left])])
            parents[c] = int(above[c])
            centres.append(c)
            d = far(c)
            d[c] = 0
            closer = d < near
            near[closer], owner[closer] = d[closer], c
            if len(centres) == n:
                break
        levels.append((centres[:], parents))
        if len(centres) == n:
            break
    # Rows hang under their nearest centre of the lowest level; a parent's rows are its children's.
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    below = {int(owner[r[0]]): Node(int(owner[r[0]]), 0.0, 0, np.sort(r), ()) for r in np.split(order, cuts)}
    below = {c: v._replace(radius=_reach(x, c, v.rows)) for c, v in below.items()}
    for up, (here, parents) in enumerate(reversed(levels)):
        if up == len(levels) - 1:
            break
        kids: dict[int, list[Node]] = {}
        for c in here:
            kids.setdefault(parents[c], []).append(below[c])
        below = {}
        for c, v in kids.items():
            if len(v) == 1:
                below[c] = v[0]._replace(level=up + 1)
                continue
            rows = np.concatenate([k.rows for k in v])
            few = len(rows) <= LEAF and (len(rows) <= FEW or all(len(k.rows) == 1 for k in v))
            below[c] = Node(c, _reach(x, c, rows), up + 1, rows, () if few else _leaves(x, v))
    (root,) = below.values()
    return root


def _leaves(x: np.ndarray, kids: list[Node]) -> tuple[Node, ...]:
    """The children; where they are more than LEAF, those of few rows together with their nearest, LEAF rows a leaf."""
    if len(kids) <= LEAF:
        return tuple(kids)
    small = [k for k in kids if len(k.rows) <= LEAF // 2]
    out = [k for k in kids if len(k.rows) > LEAF // 2]
    at, sizes = np.array([k.centre for k in small], np.int64), np.array([len(k.rows) for k in small], np.int64)
    while len(at):
        order = np.argsort(((x[at] - x[at[0]]) ** 2).sum(axis=1), kind="stable")
        take = order[: max(1, int(np.searchsorted(np.cumsum(sizes[order]), LEAF, side="right")))]
        rows = np.concatenate([small[k].rows for k in take.tolist()])
        out.append(Node(int(at[0]), _reach(x, int(at[0]), rows), small[0].level, rows, ()))
        rest = np.setdiff1d(np.arange(len(at)), take)
        small, at, sizes = [small[k] for k in rest.tolist()], at[rest], sizes[rest]
    return tuple(out) if len(out) > 1 else ()


def _reach(x: np.ndarray, centre: int, rows: np.ndarray) -> float:
    return float(np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1)).max()) * (1 + 1e-9)


class _Search:
    """One group of queries against one block; scored counts the pairs that weren't pruned."""

    def __init__(self, q, qid, floor, x, xid, k):
        self.q, self.qid, self.x, self.xid, self.k = q, qid, x, xid, k
        self.q_norm, self.x_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
        self.score = np.full((len(q), k), -np.inf)
        self.who = np.full((len(q), k), np.iinfo(np.int64).max)
        self.floor, self.scored = floor, 0

    def least(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to count, of each query."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def leaf(self, a: np.ndarray, b: np.ndarray) -> None:
        self.scored += len(a) * len(b)
        s = self.q[a] @ self.x[b].T
        s[self.qid[a][:, None] == self.xid[b][None, :]] = -np.inf
        worst = self.least(a)
        if len(b) > self.k:
            worst = np.maximum(worst, np.partition(s, len(b) - self.k, axis=1)[:, len(b) - self.k])
        i, j = np.nonzero((s >= worst[:, None]) & (s > -np.inf))
        if not len(i):
            return
        rows = np.unique(i)
        query = np.concatenate([i, np.repeat(rows, self.k)])
        score = np.concatenate([s[i, j], self.score[a[rows]].ravel()])
        who = np.concatenate([self.xid[b[j]], self.who[a[rows]].ravel()])
        order = np.lexsort((who, -score, query))
        query, score, who = query[order], score[order], who[order]
        starts = np.searchsorted(query, rows)
        take = starts[:, None] + np.arange(self.k)
        self.score[a[rows]], self.who[a[rows]] = score[take], who[take]

    def bounds(self, a: Node, nodes: list[Node]) -> np.ndarray:
        """No product of a row below a and one below each node exceeds these."""
        at, r = np.array([n.centre for n in nodes]), np.array([n.radius for n in nodes])
        with np.errstate(all="ignore"):
            top = self.x[at] @ self.q[a.centre] + a.radius * self.x_norm[at] + r * self.q_norm[a.centre] + a.radius * r
            return top + 1e-9 * (np.abs(top) + self.q_norm[a.centre] * self.x_norm[at] + 1)

    def walk(self, a: Node, b: Node) -> None:
        if self.bounds(a, [b])[0] < self.least(a.rows).min():
            return
        if a.children:  # queries part first, so that each group meets its own most promising nodes first
            for c in a.children:
                self.walk(c, b)
        elif not b.children:
            self.leaf(a.rows, b.rows)
        else:
            found = self.bounds(a, b.children)
            for k in np.argsort(-found, kind="stable").tolist():  # the most promising first
                if not found[k] < self.least(a.rows).min():
                    self.walk(a, b.children[k])


def _plain(q, qid, x, xid, k):
    """Scores beyond 2^52: exact integers, one query at a time, kept within 64 bits."""
    scores, who = [], []
    cols = [[int(v) for v in row] for row in x]
    for row, ident in zip(q, qid.tolist(), strict=True):
        one = [int(v) for v in row]
        found = sorted(((-sum(p * r for p, r in zip(one, c, strict=True)), i) for c, i in zip(cols, xid.tolist(), strict=True) if i != ident))[:k]
        scores.append([min(max(-s, -(1 << 63)), (1 << 63) - 1) for s, _ in found])
        who.append([i for _, i in found])
    return scores, who


def _widened(*parts: np.ndarray):
    width = max(m.shape[1] for m in parts)
    return (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in parts)


def _too_large(q: np.ndarray, x: np.ndarray) -> bool:
    return not float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < _EXACT


def search_block(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, x: np.ndarray, xid: np.ndarray, tree: Node | None = None, k: int = TOP):
    """For each query, lists of scores (floor or more) and ids of the k best of a block, and the pairs scored; ties go to smaller ids."""
    wide_q, wide_x = _widened(q, x)
    if _too_large(wide_q, wide_x):
        return *_plain(wide_q, qid, wide_x, xid, k), len(q) * len(x)
    s = _Search(wide_q, qid, floor, wide_x, xid, k)
    s.walk(build(wide_q), tree or build(wide_x))
    real = np.isfinite(s.score)
    return [r[m].astype(np.int64).tolist() for r, m in zip(s.score, real, strict=True)], [r[m].tolist() for r, m in zip(s.who, real, strict=True)], s.scored


def _matrix(lists: list[list[float]]) -> np.ndarray:
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width))
    for k, v in enumerate(lists):
        out[k, : len(v)] = v
    return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<double>): integers floor(scale * x); rows that are null or hold null or non-finite components go.

    A component is what scale * x is as a double, so one that this takes beyond all doubles isn't finite.
    """
    v = F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    # floor() of a double that leaves 64 bits would wrap, so the fraction is taken off instead.
    whole = lambda x: F.when(F.abs(x) < F.lit(float(1 << 52)), F.floor(x).cast("double")).otherwise(x)
    return vectors.where(ok).select(F.col(id_col).alias("id"), F.transform(v, lambda x: whole(x * scale)).alias("v"))


def net(x: np.ndarray, most: int) -> np.ndarray:
    """`most` rows of x or fewer, each the one furthest from those before; equal rows count once."""
    chosen, near = [0], np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
    return x[chosen]


def _into_cells(pivots: np.ndarray):
    """(id, v, cell, dist): the nearest pivot of each vector."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, p = _widened(_matrix(b.column(1).to_pylist()), pivots)
            with np.errstate(all="ignore"):
                d = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
                cell = d.argmin(axis=1)
                dist = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["id", "v", "cell", "dist"])

    return run


def _reachable(pivots: np.ndarray, radius: np.ndarray):
    """(id, v, home, floor, cell): the cells in which a query's floor may be reached."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, p = _widened(_matrix(b.column(1).to_pylist()), pivots)
            floor = np.asarray(b.column(3))
            with np.errstate(all="ignore"):
                q_norm, p_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((p * p).sum(axis=1))
                top = q @ p.T + q_norm[:, None] * radius[None, :]
                top += 1e-9 * (np.abs(top) + q_norm[:, None] * p_norm[None, :] + 1)
                i, j = np.nonzero(~(top < floor[:, None]))
            part = b.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(j.astype(np.int32))], names=["id", "v", "home", "floor", "cell"])

    return run


_FOUND = "query_id long, vec_id long, score long, pairs long, scored long"


def _search_blocks(k: int):
    """Results of each block's queries, which follow its candidates, and a row of pairs and pairs scored."""

    def run(batches):
        block, kind, held, x, xid, tree = None, 0, [], None, None, None

        def rows():
            ids = np.concatenate([np.asarray(i) for i, _, _ in held])
            return ids, _matrix([v for _, vs, _ in held for v in vs.to_pylist()]), np.concatenate([np.asarray(f) for _, _, f in held])

        def done():
            """Take in what is held: a block's candidates, or a group of its queries."""
            nonlocal held, x, xid, tree
            if not held:
                return
            ids, m, floor = rows()
            held = []
            if kind == 0:
                x, xid, tree = m, ids, None
                return
            if x is None or not len(x):
                return
            wide_q, wide_x = _widened(m, x)
            if tree is None and not _too_large(wide_q, wide_x):
                tree = build(wide_x)
            scores, who, scored = search_block(m, ids, floor, x, xid, tree, k)
            q = np.repeat(ids, [len(s) for s in scores])
            none = pa.nulls(len(q), pa.int64())
            yield pa.RecordBatch.from_arrays([longs(q), longs([i for w in who for i in w]), longs([v for s in scores for v in s]), none, none], names=_NAMES)
            null = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([null, null, null, longs([len(ids) * len(xid)]), longs([scored])], names=_NAMES)

        for b in batches:
            key = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in range(3)])
            cuts = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), b.num_rows] if b.num_rows else []):
                cell, sub, now = key[:, lo].tolist()
                if (cell, sub) != block or now != kind:
                    yield from done()
                    if (cell, sub) != block:
                        block, x = (cell, sub), None
                    kind = now
                step = QUERIES if now else hi - lo
                for a in range(lo, hi, step):
                    if now and sum(len(i) for i, _, _ in held) >= QUERIES:
                        yield from done()
                    part = b.slice(a, min(step, hi - a))
                    held.append((part.column(4), part.column(5), part.column(6)))
        yield from done()

    return run


_NAMES = [c.split(" ")[0] for c in _FOUND.split(", ")]


def _searched(cand: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    lowest = F.lit(float("-inf"))
    rows = cand.select("cell", "sub", F.lit(0).alias("kind"), F.lit(0).alias("home"), "id", "v", lowest.alias("floor"))
    rows = rows.union(queries.select("cell", "sub", F.lit(1).alias("kind"), "home", "id", "v", "floor"))
    return rows.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "kind", "home").mapInArrow(_search_blocks(k), _FOUND)


def _found(vectors: DataFrame, k: int, every: int, id_col: str, vec_col: str, scale: int) -> DataFrame | None:
    """All that the blocks report, or None where no vector is usable."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vec_col, scale), "vectors")
    n = rows.count()
    if not n:
        return None
    cells = max(1, min(PIVOTS, -(-n // BLOCK)))
    # About SAMPLE vectors for each of at most PIVOTS pivots reach the driver.
    sample = rows.where(F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(n)) < SAMPLE * cells).select("v").limit(2 * SAMPLE * cells).toArrow()
    lists = sorted(sample.column(0).to_pylist()) or [rows.select("v").first()[0]]
    with np.errstate(all="ignore"):
        pivots = net(_matrix(lists), cells)
    dealt = stage(rows.mapInArrow(_into_cells(pivots), "id long, v array<double>, cell int, dist double"), "dealt-vectors")
    radius, subs = np.zeros(len(pivots)), [0] * len(pivots)
    for cell, r, count in dealt.groupBy("cell").agg(F.max("dist"), F.count(F.lit(1))).collect():  # PIVOTS rows at most
        radius[cell], subs[cell] = r * (1 + 1e-9), -(-count // BLOCK)
    parts = F.element_at(F.array(*map(F.lit, subs)), F.col("cell") + 1)
    # Rows are dealt by their own content and place, so equal vectors or ids don't fill one block.
    cand = dealt.withColumn("sub", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), parts).cast("int")).select("cell", "sub", "id", "v")
    queries = dealt.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("m")).select("id", "m.v", F.col("m.cell").alias("home"))
    first = queries.withColumns({"cell": F.col("home"), "floor": F.lit(float("-inf"))}).withColumn("sub", F.pmod(F.xxhash64("id"), parts).cast("int"))
    near = stage(_searched(cand, first, k), "near-results")
    kth = near.where("query_id is not null").groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    floor = F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(F.lit(float("-inf")))
    # A score beyond 2^52 is no exact double, so it bounds nothing.
    floor = F.when(F.abs(floor) < _EXACT, floor).otherwise(F.lit(float("-inf")))
    again = queries.join(kth, "id", "left").select("id", "v", "home", floor.alias("floor"))
    again = again.mapInArrow(_reachable(pivots, radius), "id long, v array<double>, home int, floor double, cell int")
    again = again.where(parts > 0).withColumn("sub", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    again = again.where((F.col("cell") != F.col("home")) | (F.col("sub") != F.pmod(F.xxhash64("id"), parts)))
    return near.union(_searched(cand, again, k))


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Queries are rows whose id is divisible by `every`; candidates are all rows with another id. Ties go
    to smaller ids; fewer candidates give fewer rows; shorter vectors, empty ones too, count as padded with
    zeros. Vectors null or with a null or non-finite component take no part, nor do null ids. Rows that
    repeat an id stay candidates each; a repeated query is answered once, by its least vector. Other columns
    aren't read, whatever they are called. An empty table gives an empty result.
    """
    found = _found(vectors, k, every, id_col, vec_col, scale)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.where("query_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, k: int = TOP, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> tuple[int, int, int]:
    """(queries x candidates, pairs that reached a block, pairs that were scored); the rest was pruned."""
    found = _found(vectors, k, every, id_col, vec_col, scale)
    if found is None:
        return 0, 0, 0
    n = usable(vectors, id_col, vec_col, scale)
    queries = n.where(F.col("id") % every == 0).select("id").distinct().count()
    return queries * n.count(), *found.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("scored"), F.lit(0))).first()


ORACLE = """
with e as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)])::bigint as score
  from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
