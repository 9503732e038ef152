"""Hard-negative mining on cover trees over norm-augmented candidates.

Candidates are integer vectors ``floor(256 * x)``; the score of a candidate is its inner product with the
anchor.  Every candidate x gets one more coordinate ``sqrt(M^2 - |x|^2)`` (M: the largest norm of its tree), so
that all lie on one sphere and ``|q - x|^2 = |q|^2 + M^2 - 2 <q, x>`` for an anchor q with a 0 there: large
inner products are small distances, and a ball around a node bounds the products of all below it from both sides.

* The index is a forest: each block of at most ``block`` candidates is one :class:`Tree`.  A node's points are
  covered by children whose centres lie more than ``1 / base`` of the node's radius apart and within that of
  their points (the farthest point becomes the next centre, the node's own centre the first); every node keeps
  its covering radius, the largest distance to a point below it.  Equal points end in one leaf.
* A search descends best-first: each anchor opens its open node of the largest bound next and ends when no open
  node can reach its windows and its k-th best score.  Nodes whose bounds lie outside all windows of the anchor,
  or that hold no row of a wanted label, are skipped with all below them.  Leaves are verified exactly.
* Anchors come in chunks of bounded bytes, broadcast one after the other; each task keeps the k best per window
  over all its trees, so that later trees start from good bounds, and sends k rows a window at most.  In data
  without structure a tree is flat and a search reads every centre: blocks of a matrix product.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; vectors
of unequal length are compared as if the shorter ended in zeros; rows that share the anchor's vec_id are no
partners of it; a null vec_id is no anchor and comes last among ties; repeated anchors give their rows each;
anchors without a positive or without a fitting negative give no rows; an empty table gives no rows; extra
columns are ignored.  Scores must fit 63 bits; products beyond 2^53 are summed in Python integers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lexmine.llm.common import prepare, staged

LAST = (1 << 63) - 1
LEAST = -(1 << 62)
MOST = 1 << 62


@dataclass(frozen=True)
class Params:
    """``chunk_bytes``: most bytes of anchors broadcast at once; ``block``: most candidates in one tree."""

    every: int = 50
    positives: int = 5
    negatives: int = 3
    low_percent: int = 50
    high_percent: int = 95
    block: int = 2048
    leaf: int = 16
    base: float = 2.0
    chunk_bytes: int = 16 << 20
    rows_at_once: int = 256


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` with the rows of ``b``."""
    d = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x for x in (a, b))
    top = d * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)  # every partial sum is exact
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


class Tree:
    """Cover tree of one block.

    Nodes are numbered parents first; the children of node i are ``kid[i]`` to ``kid[i] + kids[i]``.  Points are
    stored in leaf order: node i holds points ``lo[i]`` to ``hi[i]``; leaves have no children.
    """

    FIELDS = ("x", "ids", "labels", "centre", "radius", "kid", "kids", "lo", "hi", "norm")

    def __init__(self, **parts):
        for k in self.FIELDS:
            setattr(self, k, parts[k])
        self.norm = float(self.norm)
        self.leaf = self.kids == 0
        # rows of each label below each node, to skip nodes without a wanted label
        self.names, code = np.unique(self.labels, return_inverse=True)
        ahead = np.zeros((len(self.ids) + 1, len(self.names)), np.int32)
        np.add.at(ahead[1:], (np.arange(len(self.ids)), code), 1)
        ahead = ahead.cumsum(0)
        self.held = ahead[self.hi] - ahead[self.lo]

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, p: Params) -> "Tree":
        f = x.astype(np.float64)
        squares = (f * f).sum(1)
        top = squares.max(initial=0.0)
        z = np.column_stack([f, np.sqrt(np.maximum(0.0, top - squares))])
        first = int(np.argmin(((z - z.mean(0)) ** 2).sum(1)))
        centre, radius, kid, kids, lo, hi = [first], [0.0], [0], [0], [0], [len(x)]
        order = np.arange(len(x))
        todo = [0]
        while todo:
            node = todo.pop()
            at = order[lo[node] : hi[node]]
            pts = z[at]
            d = np.sqrt(((pts - z[centre[node]]) ** 2).sum(1))
            radius[node] = float(d.max())
            if len(at) <= p.leaf or radius[node] == 0.0:
                continue
            reach, owner, chosen = radius[node] / p.base, np.zeros(len(at), np.int64), [centre[node]]
            while True:
                far = int(d.argmax())
                if d[far] <= reach:
                    break
                e = np.sqrt(((pts - pts[far]) ** 2).sum(1))
                closer = e < d
                owner[closer], d = len(chosen), np.where(closer, e, d)
                chosen.append(int(at[far]))
            order[lo[node] : hi[node]] = at[np.argsort(owner, kind="stable")]
            ends = lo[node] + np.cumsum(np.bincount(owner, minlength=len(chosen)))
            kid[node], kids[node] = len(centre), len(chosen)
            for c, b, e in zip(chosen, np.concatenate([[lo[node]], ends[:-1]]), ends):
                todo.append(len(centre))
                centre.append(c)
                radius.append(0.0)
                kid.append(0)
                kids.append(0)
                lo.append(int(b))
                hi.append(int(e))
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        return cls(x=x[order], ids=ids[order], labels=labels[order], centre=place[centre], radius=np.asarray(radius),
                   kid=np.asarray(kid), kids=np.asarray(kids), lo=np.asarray(lo), hi=np.asarray(hi), norm=np.sqrt(top))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{k: np.asarray(getattr(self, k)) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "Tree":
        with np.load(io.BytesIO(raw)) as z:
            return cls(**{k: z[k] for k in cls.FIELDS})


class Best:
    """The k best (score, id) of every window, by score down, then id up."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.score = np.full((windows, k), LEAST, np.int64)
        self.id = np.full((windows, k), LAST, np.int64)

    def floor(self, at) -> np.ndarray:
        """Scores below this are of no use to a window."""
        return self.score[at, -1]

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer scores to windows (equal lengths)."""
        if not len(window):
            return
        touched = np.unique(window)
        w = np.concatenate([window, np.repeat(touched, self.k)])
        s = np.concatenate([score, self.score[touched].ravel()])
        i = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        starts = np.searchsorted(w, touched)
        take = starts[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = s[take], i[take]


@dataclass
class Anchors:
    """Vectors, ids and labels; ``lo`` and ``hi`` are (anchor, window) bounds of wanted scores; ``same`` label or others."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    same: bool


def offer(tree: Tree, q: Anchors, rows: np.ndarray, a: int, b: int, best: Best) -> None:
    """Verify points ``a`` to ``b`` of the tree against the anchors ``rows``."""
    s = products(q.x[rows], tree.x[a:b])
    fit = (tree.labels[a:b][None, :] == q.labels[rows][:, None]) == q.same
    fit &= tree.ids[a:b][None, :] != q.ids[rows][:, None]
    width = q.lo.shape[1]
    for w in range(width):
        floor = np.maximum(q.lo[rows, w], best.floor(rows * width + w))
        r, c = np.nonzero(fit & (s >= floor[:, None]) & (s <= q.hi[rows, w][:, None]))
        best.add(rows[r] * width + w, s[r, c], tree.ids[a:b][c])


def bounds(tree: Tree, q: Anchors, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the inner products of anchors ``rows`` with all points below ``nodes``."""
    ip = products(q.x[rows], tree.x[tree.centre[nodes]]).astype(np.float64)
    square = (q.x[rows].astype(np.float64) ** 2).sum(1)[:, None] + tree.norm**2
    d = np.sqrt(np.maximum(0.0, square - 2 * ip))
    slack = 1 + 1e-9 * square
    near = np.maximum(0.0, d - tree.radius[nodes])
    return (square - (d + tree.radius[nodes]) ** 2) / 2 - slack, (square - near**2) / 2 + slack


def open_to(tree: Tree, q: Anchors, rows: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> np.ndarray:
    """Mask (anchor, node): some window can still gain below the node."""
    width = q.lo.shape[1]
    out = np.zeros(low.shape, bool)
    for w in range(width):
        floor = np.maximum(q.lo[rows, w], best.floor(rows * width + w)).astype(np.float64)
        out |= (high >= floor[:, None]) & (low <= q.hi[rows, w].astype(np.float64)[:, None]) & (q.lo[rows, w] <= q.hi[rows, w])[:, None]
    own = np.searchsorted(tree.names, q.labels[rows])
    known = (own < len(tree.names)) & (tree.names[np.minimum(own, len(tree.names) - 1)] == q.labels[rows])
    held = np.where(known[:, None], tree.held[nodes][:, np.minimum(own, len(tree.names) - 1)].T, 0)
    size = (tree.hi - tree.lo)[nodes][None, :]
    return out & ((held > 0) if q.same else (held < size))


def search(tree: Tree, q: Anchors, best: Best, p: Params = Params()) -> int:
    """Best-first descent of ``tree`` for all anchors at once; returns the points verified.

    Each round every anchor picks its open node of the highest bound; anchors that picked the same node open it
    together.  Leaves are verified; runs of single-point leaves in one product.
    """
    verified = 0
    for at in range(0, len(q.ids), p.rows_at_once):
        part = np.arange(at, min(len(q.ids), at + p.rows_at_once))
        root = np.zeros(1, np.int64)
        low, high = bounds(tree, q, part, root)
        # columns: nodes met so far and still to open
        nodes, lows, highs = root, low, np.where(open_to(tree, q, part, root, low, high, best), high, -np.inf)
        while len(part):
            pick = highs.argmax(1)
            top = highs[np.arange(len(part)), pick]
            live = np.flatnonzero(top > -np.inf)
            if not len(live):
                break
            new = []
            for j in np.unique(pick[live]):
                mine, node = live[pick[live] == j], int(nodes[j])
                still = open_to(tree, q, part[mine], nodes[j : j + 1], lows[mine, j : j + 1], highs[mine, j : j + 1], best)[:, 0]
                highs[mine, j] = -np.inf
                mine = mine[still]
                if not len(mine):
                    continue
                if tree.leaf[node]:
                    offer(tree, q, part[mine], int(tree.lo[node]), int(tree.hi[node]), best)
                    verified += len(mine) * int(tree.hi[node] - tree.lo[node])
                    continue
                below = np.arange(tree.kid[node], tree.kid[node] + tree.kids[node])
                single = below[tree.leaf[below] & (tree.radius[below] == 0.0)]
                # points of one place are their centre: opening them is verifying them
                for a, b in runs(tree.lo[single], tree.hi[single]):
                    offer(tree, q, part[mine], a, b, best)
                    verified += len(mine) * (b - a)
                wide = np.setdiff1d(below, single)
                if len(wide):
                    low, high = bounds(tree, q, part[mine], wide)
                    high = np.where(open_to(tree, q, part[mine], wide, low, high, best), high, -np.inf)
                    full = np.full((len(part), len(wide)), -np.inf)
                    full_low = np.zeros((len(part), len(wide)))
                    full[mine], full_low[mine] = high, low
                    new.append((wide, full_low, full))
            if new:
                nodes = np.concatenate([nodes, *(n for n, _, _ in new)])
                lows = np.concatenate([lows, *(x for _, x, _ in new)], axis=1)
                highs = np.concatenate([highs, *(x for _, _, x in new)], axis=1)
            left = (highs > -np.inf).any(0)
            nodes, lows, highs = nodes[left], lows[:, left], highs[:, left]
            if not len(nodes):
                break
    return verified


def runs(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Joined ranges of neighbouring (lo, hi)."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist())):
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; ``q`` holds the integers."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table.where(F.col("label").isNotNull() & x.isNotNull() & sound).select(
        F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), F.coalesce(label, F.col("label")).cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double"))).alias("q"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, shorter ones ended with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0]).astype(np.int64)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def forest(rows: DataFrame, p: Params) -> DataFrame:
    """(tree) of every block of ``rows`` (vec_id, label, q); a task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids, labels = (t.column(c).to_numpy() for c in ("vec_id", "label"))
            raw = Tree.build(matrix(t.column("q").chunk(0)), ids, labels, p).dump()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["tree"])

        held, size = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, p.block - size)
                held.append(part)
                size += part.num_rows
                b = b.slice(part.num_rows)
                if size == p.block:
                    yield tree(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield tree(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "tree binary")


def searched(trees: DataFrame, q: Anchors, k: int, p: Params) -> DataFrame:
    """(w, score, id): of every window (anchor number times windows plus window) the k best of every task."""
    shared = trees.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = Best(q.lo.size, k)
        for b in batches:
            for raw in b.column(0):
                search(Tree.load(raw.as_py()), q, best, p)
        w, j = np.nonzero(best.score > LEAST)
        for at in range(0, len(w), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(w[part], pa.int32()), pa.array(best.score[w[part], j[part]]), pa.array(best.id[w[part], j[part]])],
                                             ["w", "score", "id"])

    found = trees.mapInArrow(run, "w int, score long, id long")
    order = W.partitionBy("w").orderBy(F.col("score").desc(), "id")
    # at most k rows a window from each task; the group limit runs before the shuffle
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(table: DataFrame, p: Params = Params()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive."""
    spark = table.sparkSession
    prepare(spark)
    rows = staged(vectors(table), "vectors")
    trees = staged(forest(rows, p), "cover-trees", per_file=8)
    anchors = rows.where((F.col("vec_id") != LAST) & (F.col("vec_id") % p.every == 0)).groupBy("vec_id", "label", "q").agg(F.count("*").alias("copies"))
    anchors = staged(anchors, "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.sum(8 * F.size("q") + 64).alias("bytes")).first()
    chunks = max(1, -(-(size["bytes"] or 0) // p.chunk_bytes))
    out = []
    for c in range(chunks):
        part = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(chunks)) == c).toArrow()  # about `chunk_bytes`
        if part.num_rows:
            out.append(staged(_chunk(trees, part, p), "negatives"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    done = spark.createDataFrame([], schema)
    for part in out:
        done = done.unionByName(part)
    return done


def _chunk(trees: DataFrame, part: pa.Table, p: Params) -> DataFrame:
    """Negatives of one chunk of anchors: positives first, then the windows that their scores give."""
    part = part.combine_chunks()
    ids, labels, copies = (part.column(c).to_numpy() for c in ("vec_id", "label", "copies"))
    x, n = matrix(part.column("q").chunk(0)), part.num_rows
    every = np.full((n, 1), LEAST + 1), np.full((n, 1), MOST)
    top = searched(trees, Anchors(x, ids, labels, *every, True), p.positives, p).toArrow()  # `positives` rows an anchor
    score, pid = np.zeros((n, p.positives), np.int64), np.full((n, p.positives), LAST)
    lo, hi = np.ones((n, p.positives), np.int64), np.zeros((n, p.positives), np.int64)
    w, r = top.column("w").to_numpy(), top.column("rank").to_numpy() - 1
    score[w, r], pid[w, r] = top.column("score").to_numpy(), top.column("id").to_numpy()
    lo[w, r] = -(-p.low_percent * score[w, r] // 100)
    hi[w, r] = p.high_percent * score[w, r] // 100
    spark = trees.sparkSession
    found = searched(trees, Anchors(x, ids, labels, lo, hi, False), p.negatives, p)
    at = np.flatnonzero((lo <= hi).ravel())
    names = pa.table({"w": pa.array(at, pa.int32()), "anchor_id": ids[at // p.positives], "copies": copies[at // p.positives],
                      "positive_id": pid.ravel()[at], "positive_score": score.ravel()[at]})
    null = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    out = found.join(F.broadcast(spark.createDataFrame(names)), "w").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("anchor_id", null("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score")).withColumn("negative_id", null("negative_id"))


def op12_cover_tree_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.other AS negative_id, positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
