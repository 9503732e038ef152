"""Document fingerprints: a quartile bucket digest.

Byte triplets inside a sliding window of four bytes are hashed into 128 buckets; each bucket is coded in
two bits by the quartile its count falls in, after a head of two bytes that codes the length on a log
scale and one check byte.  Two digests differ by the sum of their quartile steps (opposite ends count
double) plus the length step; ``likeness`` maps the difference, bounded, to 0..1.

Defined results: a null text is the empty text; texts under three bytes have all counts 0; equal texts
have equal digests and likeness 1.  The next document follows in ascending (doc_id, text hash), null ids
first, the last row is followed by the first; a single row follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmine.llm.common import prepare

#: Difference from which two digests count as unrelated.
FAR = 220


def digest(text: str | None) -> str:
    """Hex digest of a whole text: length code, check byte, 32 bytes of quartiles."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(128, np.int64)
    if len(b) >= 3:
        mix = lambda x, y, z, salt: (((x * 0x9E3779B1) ^ (y * 0x85EBCA77) ^ (z * 0xC2B2AE3D) ^ np.uint32(salt)) * np.uint32(0x27D4EB2F)) >> np.uint32(25)
        counts += np.bincount(mix(b[:-2], b[1:-1], b[2:], 11), minlength=128)
        if len(b) >= 4:
            counts += np.bincount(mix(b[:-3], b[1:-2], b[3:], 53), minlength=128)
            counts += np.bincount(mix(b[:-3], b[2:-1], b[3:], 97), minlength=128)
    q = np.sort(counts)[[31, 63, 95]]
    code = np.searchsorted(q, counts, side="left").astype(np.uint8)  # 0..3: quartiles at or below the count
    packed = (code[0::4] << 6) | (code[1::4] << 4) | (code[2::4] << 2) | code[3::4]
    size = min(255, int(math.log(len(raw) + 1) * 12))
    check = int(counts[:64].sum() * 31 + len(raw)) % 256
    return bytes([size, check]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Quartile steps (three steps count six) plus half the length step."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    d = np.concatenate([np.abs(((x[2:] >> s) & 3).astype(int) - ((y[2:] >> s) & 3)) for s in (0, 2, 4, 6)])
    return int(d.sum() + 3 * (d == 3).sum() + abs(int(x[0]) - int(y[0])) // 2)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from a difference of ``FAR`` on."""
    return 1.0 if a == b else max(0.0, 1 - max(1, difference(a, b)) / FAR)


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """At most ``n`` cut points of the ids (quantile summary, a bounded list)."""
    got = docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return sorted({int(x) for x in got})


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (bucket, tail, doc_id, text) in whose order each row that is no tail is followed by its next document.

    The ids are cut into ranges; every range gets, as its tail, a copy of the rows that open the following
    non-empty range (the last: the first), so the whole text is shuffled once and no task sees all rows.
    """
    spark = docs.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _bounds(docs, n)

    # the number of cut points at or below an id (null: -1), in the JVM
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    src = docs.select("doc_id", "text").withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(below))
    opens = [(r["bucket"], r["lo"]) for r in src.groupBy("bucket").agg(F.min("doc_id").alias("lo")).orderBy("bucket").collect()]  # one row a range
    if not opens:
        return src.select("bucket", F.lit(False).alias("tail"), "doc_id", "text")
    before = {b: opens[i - 1][0] for i, (b, _) in enumerate(opens)}
    heads = spark.createDataFrame([(b, lo, before[b]) for b, lo in opens], "h_bucket int, lo long, home int")
    tails = src.join(F.broadcast(heads), (F.col("bucket") == F.col("h_bucket")) & F.col("doc_id").eqNullSafe(F.col("lo")))
    both = src.select("bucket", F.lit(False).alias("tail"), "doc_id", "text").union(
        tails.select(F.col("home").alias("bucket"), F.lit(True).alias("tail"), "doc_id", "text"))
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", F.xxhash64("text"))


def fingerprint_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Digest of every text, of its edited text, and their likeness; one streaming pass per range."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for its next document
        for batch in batches:
            out = []
            for tail, doc_id, text in zip(batch["tail"], batch["doc_id"], batch["text"]):
                text = text or ""
                mark = digest(text)
                if held is not None:
                    old_id, old, old_mark = held
                    m = len(old) // 4
                    edited = old[: len(old) - m] + text[:m]
                    e = digest(edited)
                    out.append((old_id, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                old_mark, e, likeness(old_mark, e), likeness(old_mark, mark)))
                held = None if tail else (doc_id, text, mark)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    # ids as text: beside a null, pandas turns 64-bit ids into floats
    src = with_next(docs, ranges).withColumn("doc_id", F.col("doc_id").cast("string"))
    out = src.mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_quartile_digest(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
