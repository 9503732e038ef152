"""Substring dedup: sliding spans of consecutive sentences.

A text is cut into sentences after words that end in ``.``, ``!`` or ``?`` (with closing quotes) and after line
ends; a sentence of more than ``long`` words is cut further, before words whose hash is the smallest among the
``around`` words on both sides, and where it is still of twice ``long`` words, every ``long`` words.  Such cuts depend on the
words nearby, so a passage is cut alike wherever it stands, in mid-sentence and without punctuation too.  The
parts are the sentences below.

From every sentence a span of consecutive sentences is hashed: as few as hold ``words`` words, but at least two
unless the text ends.  Spans are joined over all documents, and sentences covered by a repeated span that is
not its first occurrence, by (doc_id, position), are removed.  Of a repeated passage of over ``words`` and some
sentences at both ends, at most the parts of sentences at its two ends stay.

Words are runs without ASCII white space, compared with A-Z lower-cased.

Defined results: a null text stays null; texts under ``words`` words have no spans; a removed sentence goes with
the white space after it; rows with a null doc_id come last in the order, rows that repeat a doc_id are ordered by
text hash, fully equal rows count as one occurrence and get equal results; ids and extra columns never pass
through Python; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexmine.llm.common import discard, documents, prepare, staged

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ENDS = re.compile(rb"[.!?](?:[\"')\]]|\xc2\xbb|\xe2\x80\x9d)*$")
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Params:
    """``words`` a span must hold; sentences over ``long`` words are cut at hashes smallest within ``around`` words."""

    words: int = 24
    long: int = 12
    around: int = 2


class Powers:
    """Powers of the base and of its inverse, grown as texts need."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, INVERSE))
        return self.up, self.down


POWERS = Powers()


def word_table(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, whether a sentence ends after it) of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    words = raw.split()
    seen = {w: (xxhash.xxh3_64_intdigest(w), ENDS.search(w) is not None) for w in set(words)}
    pairs = [seen[w] for w in words]
    h = np.fromiter((x for x, _ in pairs), np.uint64, len(words))
    end = np.fromiter((e for _, e in pairs), bool, len(words))
    if b"\n" in raw:
        lines = np.cumsum([len(s.split()) for s in raw.split(b"\n")])
        end[lines[lines > 0] - 1] = True
    if len(end):
        end[-1] = True
    return h, end


def sentences(h: np.ndarray, end: np.ndarray, p: Params) -> np.ndarray:
    """First word of each sentence, and the number of words as the last entry."""
    n = len(h)
    starts = np.concatenate([[0], np.flatnonzero(end) + 1]) if n else np.zeros(1, np.int64)
    sizes = np.diff(starts)
    wide = sizes > p.long
    if wide.any():
        low = np.ones(n, bool)
        for k in range(1, p.around + 1):
            low[k:] &= h[k:] < h[:-k]
            low[:-k] &= h[:-k] <= h[k:]
        inside = np.repeat(wide, sizes)
        # a cut opens a sentence; the edges of the long one are no cuts
        starts = np.union1d(starts, np.flatnonzero(low & inside))
        # what is still long, such as one word over and over, is cut by count
        sizes = np.diff(starts)
        if (sizes >= 2 * p.long).any():
            more = [np.arange(a + p.long, a + k - p.long + 1, p.long) for a, k in zip(starts, sizes) if k >= 2 * p.long]
            starts = np.union1d(starts, np.concatenate(more))
    return starts


def spans(text: str | None, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, sentences) of the span from every sentence of a whole text."""
    h, end = word_table(text)
    at = sentences(h, end, p)
    m = len(at) - 1
    if not len(h) or len(h) < p.words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    stop = np.searchsorted(at, at[:-1] + p.words)  # the sentence that the span ends before
    whole = stop <= m
    first = np.flatnonzero(whole)
    stop = np.minimum(np.maximum(stop[whole], first + 2), m)
    up, down = POWERS.to(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    x = (sums[at[stop]] - sums[at[first]]) * down[at[first]]
    x = (x ^ (x >> np.uint64(31)) ^ (at[stop] - at[first]).astype(np.uint64)) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(29))).view(np.int64), first.astype(np.int32), (stop - first).astype(np.int32)


def indexed(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, key, h, i, n, again): the spans of each row as arrays; ``key`` is the text hash.

    ``again`` marks spans that the same text holds further up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        for b in batches:
            rows = []
            for h, i, n in (spans(t, p) for t in b.column(2).to_pylist()):
                again = np.ones(len(h), bool)
                again[np.unique(h, return_index=True)[1]] = False
                rows.append((h, i, n, again))
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *(len(r[k]) for r in rows)]).astype(np.int32),
                                              pa.array(np.concatenate([r[k] for r in rows]) if rows else [], kinds[k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc_id", "key", "h", "i", "n", "again"])

    src = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("key"), "text").where("text is not null")
    return src.mapInArrow(run, "doc_id long, key long, h array<long>, i array<int>, n array<int>, again array<boolean>").where(F.size("h") > 0)


def repeated_spans(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(key, doc_id, cuts): per text with a repeated span, the (first, count) ranges of sentences to remove."""
    prepare(docs.sparkSession)
    base = staged(indexed(docs, p), "span-index")
    # (doc_id, key) as one number in that order: a minimum that needs no sort
    order = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 62).cast("decimal(38,0)") + F.shiftright("key", 2)
    one = base.select("doc_id", "key", order.cast("decimal(38,0)").alias("o"), F.explode(F.arrays_zip("h", "i", "n", "again")).alias("x"))
    # partial counts on the map side: a hot passage becomes one row a task before the shuffle
    firsts = one.groupBy(F.col("x.h").alias("h")).agg(F.min("o").alias("first"), F.count("*").alias("places")).where("places > 1").select("h", "first")
    firsts = staged(firsts, "span-firsts")
    rows = one.select("doc_id", "key", F.col("x.h").alias("h"), F.col("x.i").alias("i"), F.col("x.n").alias("n"), F.col("x.again").alias("again"))
    hits = rows.join(firsts, "h").where((order > F.col("first")) | F.col("again"))
    # overlapping ranges of a text are joined in its own row
    cuts = staged(hits.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("i", "n"))).alias("c")).select(
        "doc_id", "key", joined(F.col("c")).alias("cuts")), "span-cuts")
    discard(base, firsts)
    return cuts


def joined(ranges):
    """Sorted (i, n) ranges with overlapping and touching ones made one."""
    def step(done, r):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["i"].alias("i"), F.greatest(last["n"], r["i"] + r["n"] - last["i"]).alias("n"))))
        return F.when((F.size(done) > 0) & (r["i"] <= F.get(done, F.size(done) - 1)["i"] + F.get(done, F.size(done) - 1)["n"]), grown).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, F.array().cast("array<struct<i:int,n:int>>"), step)


def removed_ranges(text: str, cuts, p: Params) -> tuple[list[tuple[int, int]], int, int]:
    """(code point ranges that go, sentences, sentences that go) for ``cuts`` of a whole text."""
    h, end = word_table(text)
    at = sentences(h, end, p)
    if not len(cuts):
        return [], len(at) - 1, 0
    starts = [m.start() for m in WORDS.finditer(text)] + [len(text)]
    return [(starts[at[c["i"]]], starts[at[c["i"] + c["n"]]]) for c in cuts], len(at) - 1, sum(c["n"] for c in cuts)


def remove_repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; adds n_sentences, n_removed, removed (text spans).

    Clashing column names of the input are replaced by the added ones.
    """
    prepare(docs.sparkSession)
    cuts = repeated_spans(docs, p)
    base = docs.select(*[c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed")])
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("cuts").alias("__cuts"))
    joined_ = base.join(cuts, (F.coalesce("doc_id", F.lit(LAST)) == F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")

    @F.pandas_udf("text string, n_sentences int, n_removed int, removed array<struct<start:int,end:int>>")
    def cut(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, m in zip(texts, marks):
            ranges, n, gone = removed_ranges(text or "", m if m is not None else [], p)
            keep, last = [], 0
            for a, b in ranges:
                keep.append(text[last:a])
                last = b
            rows.append((None if text is None else "".join(keep) + text[last:], n, gone, [{"start": a, "end": b} for a, b in ranges]))
        return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed", "removed"])

    done = joined_.withColumn("__out", cut("text", "__cuts"))
    cols = [F.col("__out.text").alias("text") if c == "text" else F.col(c) for c in base.columns]
    return done.select(*cols, "__out.n_sentences", "__out.n_removed", "__out.removed")


def op10_sentence_spans(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_sentences", "n_removed", F.to_json("removed").alias("removed_spans"), "text")
