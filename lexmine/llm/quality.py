"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score of a sparse row x:  w0 + <w, x> + 1/2 * sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ],
the sum-of-squares identity, linear in the number of non-zero features.

The query and the pipeline stage pass ``n_chars`` as metadata, by magnitude.

Defined results: a null text counts as empty; an empty text has only structure features and gets a
score like any other; null metadata is the value "missing"; repeated rows are scored each for itself, and of rows
that share a labelled ``doc_id`` the one of the smallest text hash is learned from;
a null ``doc_id`` counts as held out, and ids never pass through Python beside a null; without both classes among the learnable rows every score is the
constant prior (0.5 without labels).  Extra columns of the input are ignored by name.
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
from pyspark.sql import Column, DataFrame, functions as F

from lexmine.llm.common import held_out_col, prepare

BUCKETS = 1 << 14
STATS = 64 * 16
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Metadata columns of ``documents`` that the query and the pipeline learn from.
META = ("n_chars",)


@dataclass
class Params:
    """``max_train``: most labelled rows learned from, the only bound (rows are taken by hash of the id)."""

    max_train: int = 6000
    rank: int = 8
    epochs: int = 6
    batch: int = 64
    rate: float = 0.08
    l2: float = 1e-5
    seed: int = 17
    threshold: float = 0.3


def _bin(i: int, share: float) -> int:
    """Feature number of statistic ``i`` at ``share`` in 0..1, cut into 16 levels."""
    return BUCKETS + 16 * i + min(15, max(0, int(share * 16)))


def features(text: str | None, meta: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: hashed words (log counts, unit length), structure levels, metadata."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    counts = Counter(words)
    acc: dict[int, float] = {}
    for w, c in counts.items():
        b = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        acc[b] = acc.get(b, 0.0) + 1.0 + math.log(c)
    norm = math.sqrt(sum(v * v for v in acc.values())) or 1.0
    idx = list(acc)
    val = [v / norm for v in acc.values()]
    chars = max(1, len(text))
    lines = [s for s in text.split("\n") if s.strip()]
    tally = Counter(text)
    alpha = sum(len(w) for w in counts if w.isalpha())
    letters = sum(k for c, k in tally.items() if c.isalpha())
    upper = sum(k for c, k in tally.items() if c.isupper())
    marks = sum(k for c, k in tally.items() if not c.isalnum() and not c.isspace())
    digits = sum(k for c, k in tally.items() if c.isdigit())
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    top = max(counts.values(), default=0)
    stats = (
        min(1.0, math.log1p(n) / 12),
        len(counts) / max(1, n),
        repeats / max(1, n),
        top / max(1, n),
        upper / max(1, letters),
        min(1.0, 4 * marks / chars),
        min(1.0, 4 * digits / chars),
        letters / chars,
        len(set(lines)) / max(1, len(lines)),
        min(1.0, math.log1p(n / max(1, len(lines))) / 8),
        min(1.0, sum(map(len, words)) / max(1, n) / 16),
        alpha / max(1, sum(map(len, counts))),
    )
    for i, s in enumerate(stats):
        idx.append(_bin(i, s))
        val.append(0.5)
    for j, m in enumerate(meta):
        idx.append(_bin(40 + j, (zlib.crc32(repr(m).encode()) % 16) / 16))
        val.append(0.5)
    return np.asarray(idx, np.int32), np.asarray(val, np.float32)


class FactorMachine:
    """Binary factorisation machine trained with Adagrad on mini-batches."""

    def __init__(self, size: int, rank: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w0 = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.02, (size, rank)).astype(np.float32)

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        """Linear-time score of one row."""
        xv = val[:, None] * self.v[idx]
        s = xv.sum(0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (s @ s - (xv * xv).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, p: Params) -> "FactorMachine":
        rng = np.random.default_rng(p.seed + 1)
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.w0 = math.log(rate / (1 - rate))
        gw, gv, g0 = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(p.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), p.batch):
                pick = order[at : at + p.batch]
                idx = np.concatenate([rows[i][0] for i in pick])
                val = np.concatenate([rows[i][1] for i in pick])
                row = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
                xv = val[:, None] * self.v[idx]
                starts = np.searchsorted(row, np.arange(len(pick)))
                s = np.add.reduceat(xv, starts)
                q = np.add.reduceat(xv * xv, starts).sum(1)
                z = self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((s * s).sum(1) - q)
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[pick]) / len(pick)
                g = (d[row] * val).astype(np.float32)
                keys, inv = np.unique(idx, return_inverse=True)
                dw = np.bincount(inv, g, len(keys)) + p.l2 * self.w[keys]
                per = g[:, None] * (s[row] - xv)
                dv = np.stack([np.bincount(inv, per[:, f], len(keys)) for f in range(per.shape[1])], 1) + p.l2 * self.v[keys]
                g0 += d.sum() ** 2
                self.w0 -= p.rate * d.sum() / math.sqrt(g0)
                gw[keys] += dw**2
                gv[keys] += dv**2
                self.w[keys] -= p.rate * dw / np.sqrt(gw[keys])
                self.v[keys] -= p.rate * dv / np.sqrt(gv[keys])
        return self


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, meta_cols: tuple = ()) -> DataFrame:
    """(doc_id, text, y, metadata) of at most ``limit`` learnable labelled rows, taken by hash of the id.

    Ids that carry several labels learn the largest; held-out ids and null labels are left out.
    """
    lab = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & ~held_out_col(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select("doc_id", "text", *meta_cols).join(F.broadcast(lab), "doc_id")  # at most `limit` narrow rows
    first = F.min_by(F.struct("text", *meta_cols, "y"), F.xxhash64("text", *meta_cols)).alias("r")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "r.*")


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), meta_cols: tuple = ()) -> FactorMachine | float:
    """Learn from the bounded labelled sample; features are made on executors, the driver gets sparse rows."""
    metas = list(meta_cols)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [features(t, m) for t, m in zip(b["text"], _meta(b, metas, len(b)))]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "idx": [x[0].tolist() for x in f], "val": [x[1].tolist() for x in f]})

    rows = training_rows(docs, labels, "quality", params.max_train, meta_cols)
    got = rows.mapInPandas(featurise, "doc_id long, y int, idx array<int>, val array<float>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(np.float32) if len(got) else np.zeros(0, np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = [(np.asarray(i, np.int32), np.asarray(v, np.float32)) for i, v in zip(got["idx"], got["val"])]
    return FactorMachine(BUCKETS + STATS, params.rank, params.seed).fit(x, y, params)


def _meta(b, cols: list[str], n: int) -> list[tuple]:
    """Metadata values of each of ``n`` rows; numbers by magnitude."""
    def level(v):
        if v is None or v != v:
            return "missing"
        return int(math.log2(abs(v) + 1)) if isinstance(v, (int, float, np.number)) else v
    return [tuple(level(v) for v in row) for row in zip(*(b[c] for c in cols))] if cols else [()] * n


def scored(docs: DataFrame, model: FactorMachine | float, meta_cols: tuple = ()) -> Column:
    """Score of each row as a column; only the text and the metadata go through Python."""
    prepare(docs.sparkSession)
    metas = list(meta_cols)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: (BUCKETS + STATS) * (rank + 1) floats

    @F.pandas_udf("double")
    def run(texts: pd.Series, *values: pd.Series) -> pd.Series:
        m = shared.value
        if isinstance(m, float):
            return pd.Series(np.full(len(texts), m))
        meta = _meta(dict(zip(metas, values)), metas, len(texts))
        return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, m.margin(*features(t, k)))))) for t, k in zip(texts, meta)], dtype=np.float64)

    return run("text", *metas)


def score(docs: DataFrame, model: FactorMachine | float, params: Params = Params(), meta_cols: tuple = ()) -> DataFrame:
    """All columns of ``docs`` replaced by (doc_id, held_out, score, predicted)."""
    out = docs.select("doc_id", held_out_col(F.col("doc_id")).alias("held_out"), scored(docs, model, meta_cols).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


def keep_good(docs: DataFrame, model: FactorMachine | float, params: Params = Params(), meta_cols: tuple = ()) -> DataFrame:
    """Rows of ``docs`` (all columns, untouched) that the classifier does not reject; decided row by row, no join."""
    return docs.where(scored(docs, model, meta_cols) >= params.threshold)


def op1_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prepare(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), meta_cols=META)
    return score(docs, model, meta_cols=META)
