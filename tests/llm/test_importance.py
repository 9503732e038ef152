"""Importance resampling against sums over every feature, and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmine.llm import importance
from lexmine.llm.importance import Params

SCHEMA = "doc_id long, text string, lang string, weight string, rank int, n_words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(words, n):
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, p):
    """Rows by (doc_id, n_features, weight, score, rank), feature by feature."""
    bucket = lambda g: zlib.crc32(g.encode()) % p.buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(found(t), p.max_n))
    t = Counter(bucket(g) for x in target for g in grams(found(x), p.max_n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(p.scale * math.log((t[b] + 1) * (S + p.buckets) / ((s[b] + 1) * (T + p.buckets))))
    rows = []
    for i, text in docs:
        w = found(text)
        g = grams(w, p.max_n)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-p.scale * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(g), weight, score, len(w)))
    fit = sorted((r for r in rows if r[4] >= p.min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    drawn = fit[: p.percent * len(fit) // 100]
    out = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    rest = fit[len(drawn) :] + [r for r in rows if r[4] < p.min_words]
    return Counter(out + [(*r[:4], None) for r in rest])


def test_sliced_sum_is_the_sum():
    rng = np.random.default_rng(4)
    for size in (1, 63, 64, 1000):
        gain = rng.integers(-30_000, 30_000, size)
        planes, powers = importance.signed_planes(gain)
        at = rng.integers(0, size, 50)
        pairs = np.column_stack([at, rng.integers(1, 70_000, 50)])
        assert importance.sliced_sum(pairs, planes, powers, size) == int((gain[pairs[:, 0]] * pairs[:, 1]).sum())
    planes, powers = importance.signed_planes(np.asarray([-1, 0, 5]))
    assert importance.sliced_sum(np.zeros((0, 2), np.int64), planes, powers, 3) == 0


@pytest.mark.parametrize("p", [Params(percent=30, min_words=3), Params(buckets=97, max_n=2, percent=50, min_words=2, seed=5)])
def test_rows_match_brute_force(spark, p):
    rng = random.Random(6)
    word = lambda: rng.choice(["A", "b", "É", "straße", "x1", "Zed", "über", "q-r", "日本", "n o"]) + str(rng.randrange(9))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(150)]
    # nulls, no words, ids above 2^53 beside a null one, rows that repeat, one long text
    docs += [(None, "one two three four"), (None, None), (1 << 60, "a b c d"), ((1 << 60) + 1, "a b c d"), (7, ""), (8, "-- !"), (9, "same row here now")]
    docs += [(9, "same row here now")] * 40 + [(500, "long text " * 30_000)]
    target = ["A1 b2 über3", None, "", "Zed4 Zed4 x11"]
    got = importance.resample(
        spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in docs], SCHEMA),
        spark.createDataFrame([(1, t) for t in target], "item_id long, text string"), p)
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, target, p)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b " * 20, None, None, None, None)], SCHEMA)
    (row,) = importance.resample(one, none, Params(percent=100)).collect()
    assert row["rank"] == 1 and row["n_features"] == 40
