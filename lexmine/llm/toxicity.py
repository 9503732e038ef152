"""Toxicity: non-negative positive-unlabelled (nnPU) learning of a linear numpy classifier.

With class prior pi, confirmed toxic rows P and unlabelled rows U, the risk that is minimised is
``pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1))`` with the sigmoid loss, over all sampled rows at each step; when
the second term turns negative, the step goes the other way on that term alone, which is the non-negative
correction.  Labels 0 are never used as negatives: they only serve to estimate pi.

Features are words, first letters of words (invented or inflected words share them), and, for first letters that
two or more different words share, the share of the text that starts so, by levels; a long text that holds one
such word by chance differs from one that is full of them.

Defined results: a null text counts as empty and gets the score of the bias; repeated rows are each
scored; null ids count as held out, and ids never pass through Python beside a null; of rows that share a
sampled doc_id the one of the smallest text hash is learned from; without confirmed toxic rows every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmine.llm.common import discard, held_out_col, prepare, staged

BUCKETS = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+", re.UNICODE)

#: First letters taken from a word, and the parts of a text from which their share is a level.
STEMS = (3, 4, 5, 6, 7, 8)
LEVELS = ((256, "a"), (128, "b"), (64, "c"))


@dataclass
class Params:
    """``max_positive`` / ``max_unlabelled``: most rows learned from, taken by hash of the id.

    ``prior`` None: the share of toxic rows among the learnable labelled rows.  ``max_features`` most telling
    features get a weight (by z score, at least ``min_z``, in at least ``min_rows`` sampled rows); the bound keeps
    the dense matrix of the sample small and does not grow with the corpus.
    """

    max_positive: int = 3000
    max_unlabelled: int = 6000
    prior: float | None = None
    max_features: int = 512
    min_rows: int = 3
    min_z: float = 3.0
    steps: int = 500
    rate: float = 0.3
    l2: float = 1e-4
    threshold: float = 0.5


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def tally(text: str | None) -> Counter:
    """Lower-case letter runs of a whole text."""
    return Counter(TOKEN.findall((text or "").lower()))


def stem_features(stem: str, tokens: int, kinds: int, n: int) -> Iterator[str]:
    """Features of first letters that ``tokens`` of ``n`` tokens share, ``kinds`` different words among them."""
    yield stem + "*"
    if kinds > 1:
        yield stem + "*2"
        for part, level in LEVELS:
            if tokens * part >= n:
                yield stem + level


def buckets(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    words = tally(text)
    n = sum(words.values())
    tokens, kinds = Counter(), Counter()
    for w, k in words.items():
        for size in STEMS:
            if len(w) >= size:
                tokens[w[:size]] += k
                kinds[w[:size]] += 1
    out = {bucket(w) for w in words}
    for stem, k in tokens.items():
        out.update(map(bucket, stem_features(stem, k, kinds[stem], n)))
    return np.asarray(sorted(out), np.int32)


class Linear:
    """Weights of the chosen buckets, 0 for all others."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[int | None, tuple[str, ...]]] = {}

    def telling(self, word: str) -> tuple[int | None, tuple[str, ...]]:
        """The word's own bucket and its stems, as far as they can have a weight."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            own = bucket(word)
            stems = (word[:size] for size in STEMS if len(word) >= size)
            got = (own if own in self.weights else None,
                   tuple(s for s in stems if any(bucket(f) in self.weights for f in stem_features(s, 1, 2, 1))))
            self.known[word] = got
        return got

    def score(self, text: str | None) -> float:
        """That of all :func:`buckets`; stems without a weight are left out."""
        words = tally(text)
        tokens, kinds, out = Counter(), Counter(), set()
        for w, k in words.items():
            own, stems = self.telling(w)
            if own is not None:
                out.add(own)
            for s in stems:
                tokens[s] += k
                kinds[s] += 1
        if tokens:
            n = sum(words.values())
            for s, k in tokens.items():
                out.update(b for b in map(bucket, stem_features(s, k, kinds[s], n)) if b in self.weights)
        z = sum(self.weights[b] for b in sorted(out)) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def choose(rows: DataFrame, n_pos: int, n_unl: int, p: Params) -> list[int]:
    """The buckets whose document shares differ most between P and U (two-proportion z score); ``rows`` is (pos, idx)."""
    seen = rows.select("pos", F.explode("idx").alias("b")).groupBy("b").agg(F.sum("pos").alias("a"), F.sum(1 - F.col("pos")).alias("u"))
    pool = (F.col("a") + F.col("u")) / F.lit(float(n_pos + n_unl))
    z = F.abs(F.col("a") / n_pos - F.col("u") / n_unl) / F.sqrt(pool * (1 - pool) * (1 / n_pos + 1 / n_unl) + F.lit(1e-9))
    top = seen.where(F.col("a") + F.col("u") >= p.min_rows).withColumn("z", z).where(F.col("z") > p.min_z)
    return sorted(r["b"] for r in top.orderBy(F.col("z").desc(), "b").limit(p.max_features).collect())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(pi * R_P(+1), R_U(-1) - pi * R_P(-1)) with the sigmoid loss, and their gradients."""
    p, u = sigmoid(xp @ w), sigmoid(xu @ w)
    dp, du = xp.T @ (p * (1 - p)) / len(xp), xu.T @ (u * (1 - u)) / len(xu)
    return prior * (1 - p).mean(), u.mean() - prior * p.mean(), -prior * dp, du - prior * dp


def fit(pos: list[np.ndarray], unl: list[np.ndarray], keys: list[int], prior: float, p: Params) -> Linear:
    """Steps on the whole nnPU risk with Adagrad; rows hold buckets of ``keys`` only."""
    at = {b: k for k, b in enumerate(keys)}

    def dense(rows):
        x = np.zeros((len(rows), len(keys) + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(rows):
            x[i, [at[b] for b in r.tolist()]] = 1
        return x

    xp, xu = dense(pos), dense(unl)
    w = np.zeros(len(keys) + 1)
    w[-1] = math.log(prior / (1 - prior))
    acc = np.full_like(w, 1e-6)
    for _ in range(p.steps):
        _, negative, g_pos, g_neg = risk(w, xp, xu, prior)
        g = (-g_neg if negative < 0 else g_pos + g_neg) + p.l2 * np.append(w[:-1], 0)
        acc += g * g
        w -= p.rate * g / np.sqrt(acc)
    return Linear(dict(zip(keys, w[:-1].tolist())), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Linear | None:
    """Learn from bounded samples; executors make and choose the features."""
    prepare(docs.sparkSession)
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out_col(F.col("doc_id")))
    learn = learn.groupBy("doc_id").agg(F.max("y").alias("y"))
    seen = learn.agg(F.avg((F.col("y") == 1).cast("double")).alias("pi")).first()["pi"]
    prior = params.prior or seen
    if not prior:
        return None
    prior = min(0.99, max(0.001, prior))
    pos = learn.where("y = 1").select("doc_id", F.lit(1).alias("pos")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_positive)
    unl = (
        docs.select("doc_id").where(~held_out_col(F.col("doc_id"))).select("doc_id", F.lit(0).alias("pos"))
        .orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(params.max_unlabelled)
    )

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "pos": b["pos"], "idx": [buckets(t).tolist() for t in b["text"]]})

    ids = pos.union(unl.distinct())  # bounded by the two limits
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "pos").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = staged(rows.mapInPandas(featurise, "doc_id long, pos int, idx array<int>"), "toxicity-sample")
    size = {r["pos"]: r["n"] for r in rows.groupBy("pos").agg(F.count("*").alias("n")).collect()}
    if set(size) != {0, 1}:
        return None
    keys = choose(rows, size[1], size[0], params)
    # the driver gets the chosen buckets of the sampled rows alone
    held = F.array_intersect("idx", F.array(*map(F.lit, keys))) if keys else F.array().cast("array<int>")
    got = rows.select("doc_id", "pos", held.alias("idx")).toPandas().sort_values(["pos", "doc_id"], kind="stable")
    discard(rows)
    p, u = ([np.asarray(x, np.int32) for x in got.loc[got["pos"] == k, "idx"]] for k in (1, 0))
    return fit(p, u, keys, prior, params)


def score(docs: DataFrame, model: Linear | None, params: Params = Params()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only the text goes through Python."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `max_features` weights

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) if m else 0.0 for t in texts], dtype=np.float64)

    out = docs.select("doc_id", held_out_col(F.col("doc_id")).alias("held_out"), run("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


def op3_toxicity_nnpu(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
