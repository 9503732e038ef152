"""Hard negatives against a scan of all pairs, and the tree's own rules."""

import numpy as np
import pytest

from lexmine.llm import covertree
from lexmine.llm.covertree import Anchors, Best, Params, Tree

SCHEMA = "vec_id long, embedding array<float>, label int, q string, w string, tree string"


def brute(rows, p=Params()):
    """Every anchor against every row."""
    v = []
    for i, x, label in rows:
        if label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        v.append((i, label, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    key = lambda s: (-s[0], covertree.LAST if s[1] is None else s[1])
    out = []
    for i, label, x in v:
        if i is None or i % p.every:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), j, m == label) for j, m, y in v if j != i]
        for s, j, _ in sorted((r for r in scored if r[2]), key=key)[: p.positives]:
            fit = [r for r in scored if not r[2] and p.low_percent * s <= 100 * r[0] <= p.high_percent * s]
            out += [(i, j, k + 1, n, s, t) for k, (t, n, _) in enumerate(sorted(fit, key=key)[: p.negatives])]
    return sorted(out, key=str)


def mined(spark, rows, p):
    got = covertree.mine(spark.createDataFrame([(i, x, m, "a", "b", "c") for i, x, m in rows], SCHEMA).repartition(3), p)
    return sorted((tuple(r) for r in got.collect()), key=str)


def clustered(rng, n, d, labels=3):
    centres = rng.normal(size=(4, d))
    rows = []
    for i in range(n):
        x = centres[rng.integers(4)] + rng.normal(scale=0.05, size=d) if i % 3 else rng.normal(size=d)
        rows.append((i, [float(c) for c in x], int(rng.integers(labels))))
    return rows


def test_every_window_matches_a_scan_of_all_rows(spark):
    rng = np.random.default_rng(7)
    rows = clustered(rng, 400, 6)
    # one vector held by a third of the rows, odd rows, a repeated anchor, ids above 2^53
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(250)]
    rows += [(None, [0.5] * 6, 1), (2000, None, 1), (2050, [0.1] * 6, None), (2100, [float("nan")] * 6, 1), (2150, [float("inf")] * 6, 1),
             (2200, [0.0] * 6, 1), (2250, [], 0), (2300, [0.3, 0.4], 1), (2350, [None, 0.1, 0.1, 0.1, 0.1, 0.1], 1), (2400, [1.0] * 9, 0),
             ((1 << 60) + 24, [0.6] * 6, 0), (400, rows[50][1], 2)] + [(50, rows[50][1], rows[50][2])]
    p = Params(block=64, leaf=4, chunk_bytes=600, rows_at_once=5)
    want = brute(rows, p)
    assert len(want) > 100 and mined(spark, rows, p) == want


def test_large_components_are_summed_exactly():
    a, b = np.asarray([[1 << 30, 3]]), np.asarray([[(1 << 30) + 1, -7], [5, 1 << 29]])
    assert covertree.products(a, b).tolist() == [[(1 << 30) * ((1 << 30) + 1) - 21, 5 * (1 << 30) + 3 * (1 << 29)]]


def test_tables_without_rows_or_partners(spark):
    assert mined(spark, [], Params()) == []
    assert mined(spark, [(50, [1.0], 1)], Params()) == []
    assert mined(spark, [(50, [1.0], 1), (1, [1.0], 1)], Params()) == []


@pytest.mark.parametrize("seed", range(4))
def test_tree_rules(seed):
    """Covering radii hold, centres of siblings are apart, points are kept once, and far nodes are skipped."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-40, 40, (300, 3))
    x[:60] = x[0]
    p = Params(leaf=3)
    t = Tree.load(Tree.build(x, np.arange(300), rng.integers(0, 3, 300), p).dump())
    assert sorted(t.ids.tolist()) == list(range(300)) and all((t.x[k] == x[i]).all() for k, i in enumerate(t.ids))
    top = (x**2).sum(1).max()
    z = np.column_stack([t.x, np.sqrt(top - (t.x**2).sum(1))])
    for n in range(len(t.radius)):
        d = np.sqrt(((z[t.lo[n] : t.hi[n]] - z[t.centre[n]]) ** 2).sum(1))
        assert t.lo[n] <= t.centre[n] < t.hi[n] and d.max() == pytest.approx(t.radius[n], abs=1e-9)
        if t.kids[n]:
            kids = np.arange(t.kid[n], t.kid[n] + t.kids[n])
            assert t.lo[kids[0]] == t.lo[n] and t.hi[kids[-1]] == t.hi[n] and (t.radius[kids] <= t.radius[n] / p.base + 1e-9).all()
            c = z[t.centre[kids]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[np.triu_indices(len(kids), 1)]
            assert (apart > t.radius[n] / p.base - 1e-9).all()
    q = Anchors(x[:10] * 3, np.arange(10) + 1000, np.zeros(10, np.int64), np.full((10, 1), covertree.LEAST + 1), np.full((10, 1), covertree.MOST), False)
    best = Best(10, 3)
    seen = covertree.search(t, q, best, p)
    assert seen < 10 * 300 / 2
    for i in range(10):
        s = sorted(((-int(q.x[i] @ t.x[k]), int(t.ids[k])) for k in range(300) if t.labels[k] != 0))[:3]
        assert [(-a, b) for a, b in s] == list(zip(best.score[i].tolist(), best.id[i].tolist()))
