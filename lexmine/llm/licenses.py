"""License scans: winnowed fingerprints, an inverted index of templates, banded alignment.

Templates and texts are read as lower-case words of letters and digits.  Hashes of ``gram`` words are
winnowed with a window of ``window``; the fingerprints of all templates form an inverted index (templates
are a fixed list, so its size is known and it is broadcast).  Texts that hit a template give candidate
diagonals; around each a banded alignment of the words gives matched words and the span in the text.
An alignment that reaches the coverage leaves few words of the template out, so it holds one of any larger
number of them: those that the text has least often give the diagonals that share no fingerprint, and the
result is that of aligning at every position.

Defined results: null and empty texts, and texts without a hit, have no matches; ties go to the larger
coverage, then the template name, then the shorter span; matches of one template that overlap are one; every row of the input
gives one row; very long texts are looked up in linear time; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmine.llm.common import documents, prepare

WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")

# Public licence notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT line": "Released under the MIT License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Rights reserved": "All rights reserved.",
}


@dataclass(frozen=True)
class Params:
    """``band``: words that an alignment may drift; ``coverage``: least share of a template that matches."""

    gram: int = 3
    window: int = 4
    band: int = 8
    coverage: float = 0.8


def tokens(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end) over the whole text, in code points."""
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(WORD.pattern, text or "", re.IGNORECASE | re.ASCII)]


def grams(words: list[str], k: int) -> list[int]:
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) for i in range(len(words) - k + 1)]


def winnow(hashes: list[int], window: int) -> list[tuple[int, int]]:
    """(hash, position): the rightmost smallest hash of every window; of shorter lists the smallest."""
    if not hashes:
        return []
    out: list[tuple[int, int]] = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        low = min(part)
        at = i + max(j for j, h in enumerate(part) if h == low)
        if not out or out[-1][1] != at:
            out.append((low, at))
    return out


def align(template: list[str], words: list[str], at: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best banded common subsequence of the template near ``words[at:]``.

    ``at`` is where the template would begin; cells further than ``band`` from the diagonal are not visited.
    """
    width = 2 * band + 1
    best = [0] * (width + 1)  # best[d]: template prefix against words up to at + i + d - band
    first = [-1] * (width + 1)
    last = [-1] * (width + 1)
    for i, t in enumerate(template):
        nb, nf, nl = [0] * (width + 1), [-1] * (width + 1), [-1] * (width + 1)
        for d in range(width):
            j = at + i + d - band
            # down (skip template word): same j means diagonal cell d + 1 of the row before
            nb[d], nf[d], nl[d] = best[d + 1], first[d + 1], last[d + 1]
            if d and nb[d - 1] > nb[d]:
                nb[d], nf[d], nl[d] = nb[d - 1], nf[d - 1], nl[d - 1]
            if 0 <= j < len(words) and words[j] == t and best[d] + 1 > nb[d]:
                nb[d], nf[d], nl[d] = best[d] + 1, first[d] if first[d] >= 0 else j, j
        best, first, last = nb, nf, nl
    d = best.index(max(best[:width]))
    return best[d], first[d], last[d] + 1


class Index:
    """Inverted index: fingerprint to (template, position), and the words of all templates."""

    def __init__(self, templates: dict[str, str], p: Params):
        self.p = p
        self.words = {n: w for n, t in sorted(templates.items()) if (w := [w for w, _, _ in tokens(t)])}
        self.counts = {n: Counter(w) for n, w in self.words.items()}
        self.all = {w for t in self.words.values() for w in t}
        self.posts: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for n, w in self.words.items():
            for h, i in winnow(grams(w, p.gram), p.window):
                self.posts[h].append((n, i))

    def starts(self, words: list[str]) -> dict[str, set[int]]:
        """Where each template may begin; no alignment elsewhere reaches the coverage."""
        p, out = self.p, defaultdict(set)
        for j, h in enumerate(grams(words, p.gram)):  # the template side is winnowed; every text gram is looked up
            for n, i in self.posts.get(h, ()):
                out[n].add(j - i)
        at: dict[str, list[int]] = defaultdict(list)
        for j, w in enumerate(words):
            if w in self.all:
                at[w].append(j)
        for n, template in self.words.items():
            need = math.ceil(p.coverage * len(template))
            spare = len(template) - need
            if sum(c for w, c in self.counts[n].items() if w not in at) > spare:
                continue
            band = min(p.band, len(template))
            for i in sorted(range(len(template)), key=lambda i: len(at.get(template[i], ())))[: spare + 1]:
                for j in at.get(template[i], ()):
                    near = set(words[max(0, j - i - 2 * band) : j - i + len(template) + 2 * band])
                    if sum(c for w, c in self.counts[n].items() if w in near) >= need:
                        out[n].update(range(j - i - band, j - i + band + 1))
        return out

    def matches(self, words: list[str], starts: dict[str, set[int]]) -> list[tuple[int, int, int, str]]:
        """(first, end, matched words, template) that reach the coverage and do not overlap, best first choice."""
        p, found = self.p, set()
        for n, ats in starts.items():
            template = self.words[n]
            for at in ats:
                got, a, b = align(template, words, at, min(p.band, len(template)))
                if got >= p.coverage * len(template):
                    found.add((a, b, got, n))
        best: list[tuple[int, int, int, str]] = []  # in text order
        for m in sorted(found, key=lambda m: (-m[2], -m[2] / len(self.words[m[3]]), m[3], m[1] - m[0], m[0])):
            k = bisect.bisect(best, m)
            if (not k or best[k - 1][1] <= m[0]) and (k == len(best) or m[1] <= best[k][0]):
                best.insert(k, m)
        return best

    def scan(self, text: str | None) -> list[dict]:
        """Matches of a whole text, in text order."""
        found = tokens(text)
        words = [w for w, _, _ in found]
        return [
            {"template": n, "matched": got, "coverage": got / len(self.words[n]), "start": found[a][1], "end": found[b - 1][2]}
            for a, b, got, n in self.matches(words, self.starts(words))
        ]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, p: Params = Params()) -> DataFrame:
    """(doc_id, n_matches, license, coverage, matches) of every row; license is the widest match."""
    prepare(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES, p))
    match = "array<struct<template:string,matched:int,coverage:double,start:int,end:int>>"

    @F.pandas_udf(f"matches {match}, n int")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [index.value.scan(t) for t in texts]
        return pd.DataFrame({"matches": rows, "n": [len(r) for r in rows]})

    out = docs.select("doc_id", scan("text").alias("s"))
    top = F.array_max(F.transform("s.matches", lambda m: F.struct(m["matched"], m["coverage"], m["template"].alias("t"))))
    return out.select("doc_id", F.col("s.n").alias("n_matches"), top["t"].alias("license"), top["coverage"].alias("coverage"), F.col("s.matches").alias("matches"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).withColumn("matches", F.to_json("matches"))
