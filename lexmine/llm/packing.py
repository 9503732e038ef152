"""Packing by best-fit decreasing.

Token rows are first cut into full windows and one rest; pieces are dealt by hash into groups of bounded
size, and inside a group the rests go, longest first, into the tightest open window that still holds them.
The window is found with a segment tree indexed by remaining capacity.

Defined results: null and empty texts are the end id alone; a piece is never longer than a window, each id
lies in exactly one piece; equal lengths are taken in order of (doc_id, start); repeated rows are packed
each for itself; very long texts become many full windows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from lexmine.llm.common import documents, prepare, staged


LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Params:
    """``group``: rests packed together (about 30 MB of ids at most, at one task)."""

    window: int = 2048
    end_id: int = 1
    group: int = 8192


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity at or above a length in log time."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window that holds ``length``, removed; None if none does."""
        node = length + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths, window: int) -> tuple[list[int], list[int]]:
    """(window number, offset) of each length; ``lengths`` must not increase."""
    tree, numbers, offsets, n = CapacityTree(window), [], [], 0
    for length in lengths:
        got = tree.take(length)
        if got is None:
            got, n = (window, n), n + 1
        capacity, w = got
        numbers.append(w)
        offsets.append(window - capacity)
        if capacity > length:
            tree.add(capacity - length, w)
    return numbers, offsets


class Encoder:
    """Ids of whole texts as the tokenizer file gives them.

    ``ranks_file`` holds the same vocabulary as ranks, which tiktoken encodes several times faster.  The two
    libraries may split differently at code points without a Unicode category, and tiktoken's split has a
    backtracking limit on white space; such texts, and those that hold the literal of an added token (which
    the tokenizer file reads as one id), are encoded from the tokenizer file.
    """

    LONG_SPACE = re.compile(r"\s{4096}")

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_file:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        plain = text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text))
        if self.fast and plain and not self.LONG_SPACE.search(text) and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, p: Params = Params()) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every window-sized cut of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = Encoder(tokenizer_file, ranks_file)
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.asarray(encoder.ids(text or "") + [p.end_id], "<u4")
                for s in range(0, len(ids), p.window):
                    cut = ids[s : s + p.window]
                    out.append((doc_id, s, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    # ids as text: beside a null, pandas turns 64-bit ids into floats
    src = docs.select(F.col("doc_id").cast("string"), "text")
    out = src.mapInPandas(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(cuts: DataFrame, p: Params = Params()) -> DataFrame:
    """``cuts`` with sequence_id and offset; full windows are sequences of their own."""
    cuts = staged(cuts, "pack-pieces")
    groups = max(1, -(-cuts.where(F.col("length") < p.window).count() // p.group))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids = group["doc_id"].map(lambda x: LAST if x is None else int(x)).astype(np.int64)
        order = np.lexsort((group["ids_crc32"], group["start"], ids, -group["length"]))
        g = group.iloc[order].copy()
        number, offset = best_fit(g["length"].tolist(), p.window)
        g["sequence_id"] = (int(key[0]) << 33) + np.asarray(number, np.int64)
        g["offset"] = np.asarray(offset, np.int64)
        return g.drop(columns="group")

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # dealt by place in the written table, so that rows that repeat spread like others; full windows need no search
    place = F.xxhash64(F.substring("_metadata.file_name", 1, 10), "_metadata.row_index")
    dealt = cuts.select(F.col("doc_id").cast("string"), "start", "length", "ids_crc32", "doc_tokens", F.pmod(place, F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def op8_best_fit_pack(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return pack(pieces(documents(spark, sf_dir), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")))
