"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets of hashed word shingles are joined at ``100 * |a & b| >= percent * |a | b|``.

* Sizes are cut into bands that grow by ``(100 / percent) ** 2``; a set is indexed in its own band and, where
  it can be the smaller partner of a larger set, in the next one.  In a band whose largest size is U two linked sets differ in at
  most ``H = 2 U (100 - percent) / (100 + percent)`` shingles.
* The universe of shingles is hashed into segments; segment i allows ``t_i`` differences.  As long as the
  sum of ``t_i + 1`` exceeds H, linked sets agree within ``t_i`` on some segment.  ``t_i`` is 0 (the segment
  subset is the key) or 1 (the subset and its one-deletion neighbourhood are keys); :func:`allocate`
  chooses by cost: keys written plus the expected false matches of narrow segments.
* In a band of plain segments a set writes the first ``reach + 1 + spare`` of them, where ``reach`` bounds its
  difference from any partner in that band (:func:`reach`): both sets of a linked pair write at least as many as
  their own difference calls for, so they agree on more than ``spare`` segments that both wrote.
* Keys that more than ``hot`` classes hold are costly and left out.  Two linked sets that share no other key hold
  more than ``spare`` costly ones each.  Such sets, and they alone, are keyed once more by segments of twice the
  width with one-deletion neighbourhoods (:func:`neighbourhoods`), which a shared passage seldom fills.  Nothing
  is lost: a linked pair meets on a cheap key or both its sets are keyed again.
* Of those wider keys the ones that more than ``hot`` classes hold are left out too; sets with such a key are cut
  up by their own shingles, rarest first (:func:`rarest`): two linked sets share one of the first
  ``n - ceil(n percent / 100) + 1`` of each, and at the first one shared the rest of both must still hold the
  overlap they need.  A passage that many texts share comes last in all of them.
* Candidates are first taken as stars (each set against the smallest and the largest of its bucket); after
  verification, only pairs of one bucket that lie in different components are verified as well.  Parities of 512
  cells bound the difference of such a pair from below as the bucket is joined (:func:`_may_link`); histograms
  of 256 cells, whose steps bound it too, drop pairs that cannot link without their texts.

Verification is exact on whole sets (64-bit shingle hashes).  Equal sets are one class and are compared once.

Defined results: null and empty texts, and texts without a word, have an empty set, no links, and are their
own component; with fewer words than a shingle the whole sequence is the one shingle; a null doc_id is
ordered last; rows that repeat a doc_id keep their rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmine.llm.common import discard, documents, prepare, staged

LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Params:
    """``words`` a shingle, ``percent`` similarity, ``hot`` classes beyond which a key is costly."""

    words: int = 4
    percent: int = 85
    hot: int = 16
    width: float = 5.0


@dataclass(frozen=True)
class Band:
    """``ones`` segments with a one-deletion neighbourhood come first, then ``zeros`` plain ones."""

    number: int
    low: int
    high: int
    ones: int
    zeros: int
    spare: int


def allocate(h: int, high: int, width: float) -> tuple[int, int, int]:
    """(ones, zeros, spare) with ``2 * ones + zeros >= h + 1 + spare`` and ``spare`` plain segments at hand.

    Cost of a plain segment is one key, of a segment with neighbourhood one key a shingle and one; segments
    under ``width`` shingles match by chance, at a cost that doubles for each shingle below it.
    """
    best = None
    for ones in range(0, h // 2 + 2 if h < 8 else 1):
        need = h + 1 - 2 * ones
        spare = 0 if need <= 0 else 1 + need // 10
        zeros = max(0, need) + spare * (2 if ones else 1)  # a left-out key may cost a segment that allows one
        segments = ones + zeros
        w = high / segments
        cost = (zeros + ones * (1 + w)) * (1 + 2.0 ** (2 * max(0.0, width - w)))
        best = min(best or (cost, ones, zeros, spare), (cost, ones, zeros, spare))
    return best[1:]


@lru_cache(maxsize=None)
def band(number: int, p: Params) -> Band:
    """Band ``number`` (0: size 1)."""
    low = 1 if number == 0 else band(number - 1, p).high + 1
    high = max(low + 1, low * 100 * 100 // p.percent**2) - 1
    h = 2 * high * (100 - p.percent) // (100 + p.percent)
    if not h:
        return Band(number, low, high, 0, 0, 0)  # only equal sets link
    return Band(number, low, high, *allocate(h, high, p.width))


def band_of(size: int, p: Params) -> int:
    lo, hi = 0, 1
    while band(hi, p).high < size:
        hi += 8
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if band(mid, p).high >= size else (mid + 1, hi)
    return lo


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles of a whole text, A-Z lower-cased; sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.zeros(0, np.uint64)
    seen = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter((seen[w] for w in words), np.uint64, len(words))
    k = min(k, len(words))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def reach(n: int, b: Band, p: Params) -> int:
    """Largest difference of a set of ``n`` shingles from a linked set, the larger of the two in band ``b``."""
    return (n + min(n * 100 // p.percent, b.high)) * (100 - p.percent) // (100 + p.percent)


def segments(tokens: np.ndarray, seed: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment of each token, hash of each token, commutative sum hash of each of ``m`` segments)."""
    seg = (((mix(tokens ^ np.uint64(seed)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    part = mix(tokens + np.uint64(0xA0761D6478BD642F))
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg, part)
    return seg, part, total


def signatures(tokens: np.ndarray, b: Band, p: Params) -> np.ndarray:
    """Keys of a set in a band: a hash per segment subset, and less one token where allowed."""
    m = b.ones + b.zeros
    if not m:
        return np.zeros(0, np.int64)
    seg, part, total = segments(tokens, b.number * 2 + 1, m)
    tag = mix(np.arange(m, dtype=np.uint64) + np.uint64(b.number << 32))
    if not b.ones:
        take = reach(len(tokens), b, p) + 1 + b.spare
        return np.unique(mix(total[:take] + tag[:take])).view(np.int64)
    near = seg < b.ones
    s = seg[near]
    return np.unique(np.concatenate([mix(total + tag), mix(total[s] - part[near] + tag[s])])).view(np.int64)


def neighbourhoods(tokens: np.ndarray, b: Band, p: Params) -> np.ndarray:
    """Keys of a set by segments that all allow one difference: each subset, and each less one token.

    Linked sets are within one token on more than ``spare`` of the segments that both write.  Where both are, they
    share a key that holds a token unless both have under two tokens there; a set with at most ``spare`` such thin
    segments leaves the keys without a token out.
    """
    h = 2 * b.high * (100 - p.percent) // (100 + p.percent)
    spare = 1 + h // 16
    m = h // 2 + 1 + spare
    seg, part, total = segments(tokens, (1 << 40) + b.number, m)
    take = reach(len(tokens), b, p) // 2 + 1 + spare
    tag = mix(np.arange(m, dtype=np.uint64) + np.uint64((1 << 52) + (b.number << 32)))
    size = np.bincount(seg, minlength=m)[:take]
    thin = (size < 2).sum() <= spare
    whole = np.arange(take)[size > 0] if thin else np.arange(take)
    less = (seg < take) & ((np.bincount(seg, minlength=m)[seg] > 1) | (not thin))
    s = seg[less]
    return np.unique(np.concatenate([mix(total[whole] + tag[whole]), mix(total[s] - part[less] + tag[s])])).view(np.int64)


def histogram(tokens: np.ndarray) -> bytes:
    """Shingles in each of 256 hash cells, at most 255; the summed steps between two never exceed ``|a ^ b|``."""
    cells = np.bincount((mix(tokens + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(56)).astype(np.int64), minlength=256)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def parities(tokens: np.ndarray) -> np.ndarray:
    """512 bits in eight longs: whether a hash cell holds an odd number of shingles; unlike bits never exceed ``|a ^ b|``."""
    cells = np.bincount((mix(tokens + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def indexed(docs: DataFrame, p: Params, row: Column | None = None) -> DataFrame:
    """(doc_id, n, sh, cells, bits, keys): set size, class of equal sets, histogram, parities, and the keys of both bands.

    ``row`` (long) is carried along under that name.
    """
    more = [] if row is None else [row.alias("row")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, sh, cells, bits, keys = [], [], [], [], []
            for text in batch["text"]:
                t = shingles(text, p.words)
                n.append(len(t))
                sh.append(xxhash.xxh3_64_intdigest(t.tobytes()) - (1 << 63) if len(t) else 0)
                cells.append(histogram(t))
                bits.append(parities(t).tolist())
                own = band_of(len(t), p) if len(t) else 0
                keys.append([(x.number, x.spare, signatures(t, x, p)) for x in (band(own, p), band(own + 1, p))
                             if x.ones + x.zeros and 100 * len(t) >= p.percent * x.low] if len(t) else [])
            yield pd.DataFrame({
                **{c: batch[c] for c in batch.columns if c == "row"}, "doc_id": batch["doc_id"], "n": n, "sh": np.asarray(sh, np.int64), "cells": cells, "bits": bits,
                "keys": [[{"band": a, "spare": e, "sigs": s.tolist()} for a, e, s in k] for k in keys]})

    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", *more).mapInPandas(
        run, ("row long, " if more else "") + "doc_id long, n long, sh long, cells binary, bits array<long>, keys array<struct<band:int,spare:int,sigs:array<long>>>")


def verified(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets link; ``texts`` is (sh, z) from :func:`packed_texts`."""

    @F.pandas_udf("boolean")
    def link(a: pd.Series, b: pd.Series) -> pd.Series:
        @lru_cache(maxsize=256)
        def tokens(z: bytes) -> np.ndarray:
            return shingles(zstandard.decompress(z).decode("utf-8", "surrogatepass"), p.words)

        def one(x: bytes, y: bytes) -> bool:
            s, t = tokens(x), tokens(y)
            c = len(np.intersect1d(s, t, assume_unique=True))
            return 100 * c >= p.percent * (len(s) + len(t) - c)

        return pd.Series([one(bytes(x), bytes(y)) for x, y in zip(a, b)], dtype=bool)

    left, right = (texts.select(F.col("sh").alias(x), F.col("z").alias(f"z_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").where(link("z_a", "z_b")).select("a", "b")


def packed_texts(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """(sh, z): compressed text of one document of each wanted class; texts shuffle smaller than sets.

    ``wanted`` is (doc_id, sh); rows that repeat the doc_id with another set are dropped after hashing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=6)
        for b in batches:
            out = [(s, pack.compress(x.encode("utf-8", "surrogatepass"))) for x, s in zip(b["text"], b["sh"])
                   if x is not None and xxhash.xxh3_64_intdigest(shingles(x, p.words).tobytes()) - (1 << 63) == s]
            yield pd.DataFrame({"sh": np.asarray([x for x, _ in out], np.int64), "z": [z for _, z in out]})

    src = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text").join(wanted, "doc_id")
    return src.select("sh", "text").mapInPandas(run, "sh long, z binary")


def keyed_again(rows: DataFrame, p: Params) -> DataFrame:
    """(sh, sig): keys by :func:`neighbourhoods` of ``rows`` (sh, band, z)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sh, number, z in zip(batch["sh"], batch["band"], batch["z"]):
                tokens = shingles(zstandard.decompress(bytes(z)).decode("utf-8", "surrogatepass"), p.words)
                sig = neighbourhoods(tokens, band(int(number), p), p)
                yield pd.DataFrame({"sh": np.full(len(sig), sh, np.int64), "sig": sig})

    return rows.select("sh", "band", "z").mapInPandas(run, "sh long, sig long").distinct()


def rarest(rows: DataFrame, p: Params) -> DataFrame:
    """(sh, sig, pos): the shingles of ``rows`` (sh, z) among whose first, rarest in ``rows`` first, linked sets share one.

    ``pos`` counts a set's shingles before it.  Shingles that one set alone holds come first of all and are not returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sh, z in zip(batch["sh"], batch["z"]):
                tokens = shingles(zstandard.decompress(bytes(z)).decode("utf-8", "surrogatepass"), p.words)
                yield pd.DataFrame({"sh": np.full(len(tokens), sh, np.int64), "n": len(tokens), "sig": tokens.view(np.int64)})

    tokens = staged(rows.select("sh", "z").dropDuplicates(["sh"]).mapInPandas(run, "sh long, n long, sig long"), "jaccard-tokens")
    common = tokens.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1")
    own = Window.partitionBy("sh")
    at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "sig")) - 1
    out = tokens.join(common, "sig").select("sh", "n", "sig", at.alias("pos"))
    out = staged(out.where(100 * F.col("pos") <= F.col("n") * (100 - p.percent)).select("sh", "sig", "pos"), "jaccard-rarest")
    discard(tokens)
    return out


def components(links: DataFrame) -> DataFrame:
    """(sh, root): smallest class reachable by links (a, b); large-star / small-star rounds on written tables."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        older, edges = edges, staged(small.where("u != v").distinct(), "cc")
        discard(older)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "sh")
        before = now


def _chain(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("sh").alias("a"), F.col("root").alias("b"))


_FACTS = ("sh", "root", "pos", "n", "bits")


def opened(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (sig, sh, ...) of the buckets that hold unlike components, with their ``root``."""
    at = rows.join(roots, "sh", "left").withColumn("root", F.coalesce("root", "sh"))
    open_ = at.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("sig")
    return at.join(open_, "sig")


def unlike(rows: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of one bucket but unlike components that :func:`_may_link`."""
    x, y = (rows.select("sig", F.struct(*_FACTS).alias(s)) for s in "ab")
    both = x.join(y, "sig").where("a.sh < b.sh").where(_may_link(F.col("a"), F.col("b"), p))
    return both.select(F.col("a.sh").alias("a"), F.col("b.sh").alias("b")).distinct()


def neighbours(rows: DataFrame, p: Params) -> DataFrame:
    """Some of the pairs of :func:`unlike`: each row against six rows before it in its bucket by size, so as many as rows."""
    order = Window.partitionBy("sig").orderBy("n", F.xxhash64("sh", "sig"))
    own = F.struct(*_FACTS)
    rows = rows.select(own.alias("a"), F.array(*(F.lag(own, d).over(order) for d in (1, 2, 4, 8, 16, 32))).alias("near"))
    rows = rows.select("a", F.explode(F.filter("near", lambda b: b.isNotNull() & _may_link(F.col("a"), b, p))).alias("b"))
    return rows.select(F.least("a.sh", "b.sh").alias("a"), F.greatest("a.sh", "b.sh").alias("b")).distinct()


def linked(docs: DataFrame, p: Params, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows as :func:`indexed` gives them, the classes with a set (sh, doc_id, n, cells, bits), and (sh, root) of linked classes."""
    prepare(docs.sparkSession)
    index = staged(indexed(docs, p, row), "jaccard-index")
    base = staged(index.drop("keys"), "jaccard-sets")
    keys = index.select("sh", F.explode("keys").alias("k")).select("sh", "k.band", "k.spare", F.explode("k.sigs").alias("sig"))
    buckets = keys.groupBy("sig").agg(F.count("*").alias("c"), F.min("sh").alias("lo"), F.max("sh").alias("hi")).where("lo < hi")
    buckets = staged(buckets, "jaccard-buckets")
    live = staged(keys.join(buckets, "sig").select("sh", "band", "spare", "sig", "lo", "hi").distinct(), "jaccard-live")
    discard(index, buckets)
    held = live.groupBy("sig").agg((F.count("*") > p.hot).alias("costly"))
    marked = staged(live.join(held, "sig"), "jaccard-marked")
    discard(live)
    cheap = marked.where("not costly").select("sh", "sig", "lo", "hi")
    again = marked.where("costly").groupBy("sh", "band", "spare").agg(F.count("*").alias("k")).where("k > spare").select("sh", "band")

    sizes = base.where("n > 0").groupBy("sh").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("cells").alias("cells"), F.first("bits").alias("bits"))
    sizes = staged(sizes, "jaccard-classes")
    members = cheap.select("sh").union(again.select("sh")).distinct().join(sizes.select("sh", "doc_id"), "sh")
    texts = staged(packed_texts(docs, members.select("doc_id", "sh"), p), "jaccard-texts")
    second = staged(keyed_again(again.join(texts, "sh"), p), "jaccard-second")
    bounds = [F.min("sh").alias("lo"), F.max("sh").alias("hi")]
    shared = second.groupBy("sig").agg(*bounds, (F.count("*") > p.hot).alias("costly")).where("lo < hi")
    wide = staged(second.join(shared, "sig"), "jaccard-wide")
    discard(second)
    third = rarest(wide.where("costly").select("sh").distinct().join(texts, "sh"), p)
    held = third.groupBy("sig").agg(*bounds).where("lo < hi")
    cheap = cheap.union(wide.where("not costly").select("sh", "sig", "lo", "hi")).withColumn("pos", F.lit(0).cast("long"))
    kept = staged(cheap.union(third.join(held, "sig").select("sh", "sig", "lo", "hi", "pos")), "jaccard-kept")
    discard(marked, wide, third)
    star = kept.select(F.col("sh").alias("b"), F.explode(F.array("lo", "hi")).alias("a")).where("a != b")
    star = staged(near_sizes(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sizes, p), "jaccard-star")
    links = staged(verified(star, texts, p), "jaccard-links")
    roots = staged(components(links), "jaccard-roots")

    rest = opened(kept.select("sig", "sh", "pos"), roots).join(sizes.select("sh", "n", "bits"), "sh")
    rest = staged(rest, "jaccard-open")
    near = staged(near_sizes(neighbours(rest, p).join(star, ["a", "b"], "left_anti"), sizes, p), "jaccard-near")
    more_links = staged(verified(near, texts, p), "jaccard-links2")
    merged = staged(components(_chain(roots).union(more_links)), "jaccard-roots2")

    left = staged(opened(rest.drop("root"), merged), "jaccard-open2")
    more = unlike(left, p).join(star.union(near), ["a", "b"], "left_anti")
    more = staged(near_sizes(more, sizes, p), "jaccard-more")
    late = staged(verified(more, texts, p), "jaccard-late")
    last = staged(components(_chain(merged).union(late)), "jaccard-roots3")
    discard(kept, star, texts, links, roots, rest, near, more_links, merged, left, more, late)
    return base, sizes, last


def classes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    base, sizes, roots = linked(docs, p)
    named = sizes.join(roots, "sh", "left").select("sh", "doc_id", F.coalesce("root", "sh").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("sh", "component_id")
    key = F.when(F.col("n") > 0, F.col("sh")).otherwise(F.xxhash64("doc_id"))  # spreads empty sets
    out = base.select("doc_id", "n", key.alias("sh")).join(named, "sh", "left")
    cid = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    null = lambda c: F.when(c != LAST, c)
    return out.select(null(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null(cid).alias("component_id"))


def _sizes_fit(p: Params):
    return 100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b")


def _may_link(a: Column, b: Column, p: Params) -> Column:
    """Whether two rows (root, pos, n, bits) of a bucket lie in unlike components and can link.

    Their sizes fit, what is left of both from the shared key on can hold the overlap a link takes, and few enough
    parities differ.  A linked pair passes at the first shingle it shares and, where ``pos`` is 0, at every key.
    """
    both = a["n"] + b["n"]
    left = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    odd = sum(F.bit_count(a["bits"][i].bitwiseXOR(b["bits"][i])) for i in range(8))
    fit = 100 * F.least(a["n"], b["n"]) >= p.percent * F.greatest(a["n"], b["n"])
    return (a["root"] != b["root"]) & fit & (left * (100 + p.percent) >= both * p.percent) & (odd * (100 + p.percent) <= both * (100 - p.percent))


def near_sizes(pairs: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """Pairs that the exact bounds allow: set sizes, and the histogram steps against ``H``.

    Drops only pairs that cannot link, before their texts are shuffled.
    """

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(map(bytes, s)), np.uint8).reshape(-1, 256).astype(np.int16) for s in (a, b))
        steps = np.abs(x - y).sum(1, dtype=np.int64)
        return pd.Series(steps * (100 + p.percent) <= n.to_numpy() * (100 - p.percent))

    a, b = (sizes.select(F.col("sh").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"c_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").where(_sizes_fit(p))
    return both.where(close("c_a", "c_b", F.col("n_a") + F.col("n_b"))).select("a", "b")


def one_per_component(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` (all columns) with one row of every component: that of the smallest doc_id (null last).

    Decided by row: rows that share a doc_id, or have none, go only if their own text links to a row that stays.
    Of rows with the kept doc_id the smallest row hash stays, of fully equal rows one.  Rows without words link
    to nothing and all stay.
    """
    columns = docs.columns
    row, doc_id = F.xxhash64(*columns), F.coalesce("doc_id", F.lit(LAST))
    base, _, roots = linked(docs, p, row)
    # partial counts on the map side: a row that repeats becomes one row a task before the shuffle
    rows = staged(base.where("n > 0").groupBy("doc_id", "row").agg(F.min("sh").alias("sh"), F.count("*").alias("copies")), "jaccard-rows")
    firsts = rows.groupBy("sh").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    firsts = firsts.join(roots, "sh", "left").groupBy(F.coalesce("root", "sh").alias("root")).agg(F.min("first").alias("first"))
    firsts = firsts.select("first.*", F.lit(True).alias("stays"))
    marks = rows.join(firsts, ["doc_id", "row"], "left").where("stays is null or copies > 1")
    marks = staged(marks.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "stays"), "jaccard-marks")
    at = (doc_id == F.col("__id")) & (row == F.col("__row"))
    out = docs.join(marks, at, "left_anti")
    repeated = marks.where("stays")
    return out if repeated.isEmpty() else out.union(docs.join(repeated, at, "left_semi").dropDuplicates())


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
