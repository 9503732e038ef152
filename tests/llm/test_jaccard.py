"""Keys of the n-gram Jaccard join: linked sets always meet, also where every key is costly."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lexmine.llm import jaccard
from lexmine.llm.jaccard import Params, band, band_of


def meets(a: np.ndarray, b: np.ndarray, p: Params, keys) -> np.ndarray:
    """Keys that two sets share in the band of the larger one."""
    x = band(band_of(max(len(a), len(b)), p), p)
    return np.intersect1d(keys(a, x, p), keys(b, x, p))


def linked_pair(rng: np.random.Generator, n: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Two sets at the edge of the threshold."""
    both = rng.integers(0, 2**63, n, dtype=np.uint64)
    room = (n * 100 // p.percent) - n  # union - intersection
    left = int(rng.integers(0, room + 1))
    a = np.unique(np.concatenate([both, rng.integers(0, 2**63, left, dtype=np.uint64)]))
    b = np.unique(np.concatenate([both, rng.integers(0, 2**63, room - left, dtype=np.uint64)]))
    return a, b


@pytest.mark.parametrize("p", [Params(), Params(words=5, percent=80)])
def test_linked_sets_share_more_than_spare_keys(p):
    rng = np.random.default_rng(7)
    for n in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(20):
            a, b = linked_pair(rng, n, p)
            x = band(band_of(max(len(a), len(b)), p), p)
            if not x.ones + x.zeros:
                assert np.array_equal(a, b)
                continue
            assert len(meets(a, b, p, jaccard.signatures)) > x.spare
            assert len(meets(a, b, p, jaccard.neighbourhoods)) >= 1


@pytest.mark.parametrize("hot", [0, 2, 16])
def test_shared_passages_and_copies_match_brute_force(spark, hot):
    rnd = random.Random(hot)
    p = Params(words=3, percent=80, hot=hot)
    word = lambda: f"w{rnd.randrange(100_000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " ", "one", "one", "one two"]
    for _ in range(40):  # most shingles shared by all, not all of them linked
        texts.append(" ".join(passage + [word() for _ in range(rnd.randrange(4, 40))]))
    for base in list(texts[6:26]):
        words = base.split()
        words[rnd.randrange(len(words))] = word()
        texts += [" ".join(words), base]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(texts))}


def crowd(rnd: random.Random, n: int) -> list[str]:
    """Texts that share a passage of half their words and do not link, and a near copy of every fourth."""
    word = lambda: f"w{rnd.randrange(1_000_000)}"
    passage = [word() for _ in range(60)]
    texts = [passage + [word() for _ in range(60)] for _ in range(n)]
    texts += [t[:-1] + [word()] for t in texts[::4]]
    return [" ".join(t) for t in texts]


def links(texts: list[str], p: Params) -> set[tuple[int, int]]:
    sets = [jaccard.shingles(t, p.words) for t in texts]
    common = lambda a, b: len(np.intersect1d(a, b))
    return {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j])
            if 100 * common(a, b) >= p.percent * (len(a) + len(b) - common(a, b))}


def test_rarest_shingles_of_linked_sets_meet_and_a_passage_is_no_key(spark):
    p, texts = Params(words=3, percent=80), crowd(random.Random(3), 80)
    jaccard.prepare(spark)
    rows = [(i, bytearray(zstandard.compress(t.encode()))) for i, t in enumerate(texts)]
    rows += rows[:5]  # a class may come twice
    met = {}
    for r in jaccard.rarest(spark.createDataFrame(rows, "sh long, z binary"), p).collect():
        met.setdefault(r.sig, []).append(r.sh)
    pairs = {(a, b) for held in met.values() for a in held for b in held if a < b}
    assert pairs == links(texts, p) and len(pairs) == 20


def test_bucket_of_unlike_components_makes_only_pairs_that_can_link(spark):
    p, texts = Params(words=3, percent=80), crowd(random.Random(4), 80)
    rows = [(1, i, i, 0, len(t), jaccard.parities(t).tolist()) for i, t in enumerate(jaccard.shingles(x, 3) for x in texts)]
    rows = spark.createDataFrame(rows, "sig long, sh long, root long, pos long, n long, bits array<long>")
    made, linked = {tuple(r) for r in jaccard.unlike(rows, p).collect()}, links(texts, p)
    assert linked <= made and len(made) < 5 * len(texts)  # 4,950 pairs
    assert {tuple(r) for r in jaccard.neighbours(rows, p).collect()} <= made
    joined = rows.withColumn("root", F.lit(0).cast("long"))
    assert jaccard.unlike(joined, p).isEmpty()


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 30, 600, 5000):
        a, b = linked_pair(rng, n, Params())
        odd = int(np.bitwise_count((jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64)).sum())
        assert odd <= len(np.setxor1d(a, b))
