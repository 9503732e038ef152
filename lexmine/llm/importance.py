"""Target-distribution importance resampling with bit-sliced weights.

Words are runs of ASCII letters and digits and of all other code points above 0x7F, A-Z lower-cased;
features are all runs of 1 to ``max_n`` consecutive words, hashed by CRC-32 into ``buckets``.  The gain of a
bucket is the floored, scaled log ratio of its smoothed shares in the target and in the documents.

The weight of a document is the floored mean of the gains of its features.  It is summed bit-sliced: the
document's bucket counts become planes of ``buckets`` bits (plane j holds bit j of every count), the gains
become planes in two's complement (the top one counts negative), and

    sum = sum over j, k of  +-2 ** (j + k) * popcount(count plane j  AND  gain plane k),

exact in integers.  Added to it is Gumbel noise from a hash of the doc_id, and the ``percent`` highest scores
among documents of at least ``min_words`` words are drawn, ties to the smaller doc_id.

Counts and gains are tables of ``buckets`` rows whatever the input.  The drawn rows are ranked without a global
sort: scores are integers in a fixed range (gains and noise are bounded), so rows per score are counted, the
counts summed down the scores, and only rows of one score are ordered among themselves.

Defined results: null and empty texts, and texts without a word, have no features, weight 0, and are never
drawn; a null doc_id hashes as the empty string and comes last among ties; repeated rows are documents of
their own; an empty ``docs`` gives no rows; an empty target gives every bucket t = T = 0; extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lexmine.llm.common import documents, prepare, staged

#: Bytes that end a word become blanks, A-Z become a-z; bytes of code points above 0x7F stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Params:
    buckets: int = 10_000
    max_n: int = 1
    scale: int = 1000
    percent: int = 10
    min_words: int = 20
    seed: int = 2024


def words(text: bytes | None) -> list[bytes]:
    """Words of a whole text in UTF-8 (null: none)."""
    return (text or b"").translate(FOLD).split()


def features(found: list[bytes], p: Params) -> tuple[np.ndarray, int]:
    """Bucket of each distinct feature repeated by its count, as (bucket, count) rows, and the number of features."""
    tally = Counter(found)
    for n in range(2, p.max_n + 1):
        tally.update(b" ".join(found[i : i + n]) for i in range(len(found) - n + 1))
    pairs = np.fromiter((v for w, c in tally.items() for v in (zlib.crc32(w) % p.buckets, c)), np.int64, 2 * len(tally))
    return pairs.reshape(-1, 2), sum(tally.values())


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(bits, ceil(len / 64)) words; plane j holds bit j of each value (two's complement)."""
    wide = np.zeros(-(-len(values) // 64) * 64, np.int64)
    wide[: len(values)] = values
    on = (wide[None, :] >> np.arange(bits)[:, None]) & 1
    return np.packbits(on.astype(np.uint8), axis=1).view(np.uint64)


def signed_planes(gains: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Planes of the gains and the weight of each, the sign plane last and negative."""
    bits = max(int(np.abs(gains).max(initial=0)).bit_length(), 1) + 1
    return planes(gains, bits), [1 << k for k in range(bits - 1)] + [-(1 << (bits - 1))]


def sliced_sum(pairs: np.ndarray, gain_planes: np.ndarray, powers: list[int], buckets: int) -> int:
    """Exact sum of count times gain over all buckets."""
    counts = np.zeros(buckets, np.int64)
    np.add.at(counts, pairs[:, 0], pairs[:, 1])
    total = 0
    for j, plane in enumerate(planes(counts, int(counts.max(initial=0)).bit_length())):
        ones = np.bitwise_count(gain_planes & plane).sum(axis=1, dtype=np.int64)
        total += sum(int(n) * w for n, w in zip(ones, powers)) << j
    return total


def bucket_counts(texts: DataFrame, p: Params = Params()) -> np.ndarray:
    """Features of all rows of ``texts`` (column ``text``) per bucket; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, np.int64)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                pairs, _ = features(words(t), p)
                np.add.at(total, pairs[:, 0], pairs[:, 1])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    got = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(p.buckets, np.int64)
    for r in got.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, p: Params = Params()) -> np.ndarray:
    """floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    S, T = float(source.sum()), float(target.sum())
    return np.asarray([math.floor(p.scale * math.log((t + 1.0) * (S + p.buckets) / ((s + 1.0) * (T + p.buckets))))
                       for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, p: Params = Params()) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(signed_planes(gain))  # some 17 planes of `buckets` bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_planes, powers = shared.value
        for b in batches:
            n_words, n_features, weight = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                found = words(t)
                pairs, n = features(found, p)
                n_words.append(len(found))
                n_features.append(n)
                weight.append(sliced_sum(pairs, gain_planes, powers, p.buckets) // n if n else 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, p: Params = Params()):
    """floor(-scale * ln(-ln(u))) with u from the first 32 bits of sha256("seed:doc_id")."""
    name = F.concat(F.lit(f"{p.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(p.scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds ``rank`` to a written table of (doc_id, n_words, n_features, weight, score)."""
    fit = scored.where(F.col("n_words") >= p.min_words)
    per_score = {r["score"]: r["n"] for r in fit.groupBy("score").agg(F.count("*").alias("n")).collect()}  # integers in a fixed range
    draw, above, offsets = p.percent * sum(per_score.values()) // 100, 0, []
    for score in sorted(per_score, reverse=True):
        if above >= draw:
            break
        offsets.append((score, above))
        above += per_score[score]
    kept = ["doc_id", "n_features", "weight", "score"]
    if not offsets:
        return scored.select(*kept, F.lit(None).cast("long").alias("rank"))
    least = offsets[-1][0]
    table = scored.sparkSession.createDataFrame(offsets, "score long, above long")
    inside = (F.col("n_words") >= p.min_words) & (F.col("score") >= least)
    # rows that repeat become one row with a count before they are ordered
    rows = scored.where(inside).groupBy(*kept).agg(F.count("*").alias("copies")).join(F.broadcast(table), "score")
    order = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("top", F.col("above") + F.sum("copies").over(order))
    rows = rows.select(*kept, F.explode(F.sequence(F.col("top") - F.col("copies") + 1, "top")).alias("rank"))
    drawn = rows.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.where(~inside).select(*kept, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``target`` holds the wanted texts."""
    prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs, p), bucket_counts(target, p), p)
    rows = weighted(docs, gain, p).withColumn("score", F.col("weight") + noise(F.col("doc_id"), p))
    return ranked(staged(rows, "importance"), p)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) AS c FROM range(256) r(i))),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM dw UNION SELECT w FROM b)),
crc AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS INT), 2))::BIGINT),
                lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS k
  FROM hexed, tab),
s AS (SELECT k, sum(c) AS n FROM dw JOIN crc USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN crc USING (w) GROUP BY k),
tot AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS tt),
gain AS (
  SELECT s.k, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (ss + 10000) / ((s.n::DOUBLE + 1) * (tt + 10000)))) AS g
  FROM s LEFT JOIN t ON s.k = t.k, tot),
wt AS (SELECT r, sum(c) AS n, sum(c * g) AS total FROM dw JOIN crc USING (w) JOIN gain USING (k) GROUP BY r),
sc AS (
  SELECT d.doc_id, len(d.w) AS n_features, CAST(CASE WHEN len(d.w) = 0 THEN 0 ELSE floor(total / n) END AS BIGINT) AS weight,
         CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM d LEFT JOIN wt USING (r)),
f AS (SELECT doc_id, n_features, weight, weight + noise AS score FROM sc),
rk AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS k FROM f)
SELECT doc_id, n_features, weight, score,
       CASE WHEN k <= 10 * (SELECT count(*) FROM f WHERE n_features >= 20) // 100 THEN k END AS rank
FROM rk
"""
