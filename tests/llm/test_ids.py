"""Every query and the pipeline over a table with null ids, ids above 2^53, odd texts and repeated rows."""

import hashlib
import random
from collections import Counter

import pytest

from lexmine.llm import digest, packing, toxicity
from lexmine.llm.queries import REGISTRY

BIG = (1 << 60) + 1
WORDS = ["alpha", "beta", "gamma", "delta", "stone", "river", "cloud", "green", "seven", "night", "paper", "glass"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.4 else "") + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_root):
    rng = random.Random(12)
    rows = [(BIG + i, prose(rng, 60 + i), "en", "a" if i % 3 else None, 300) for i in range(40)]
    rows += [(None, prose(rng, 80), "en", "a", 400), (None, prose(rng, 70), None, None, None), (BIG + 100, None, "en", "a", None),
             (BIG + 101, "", "en", "b", 0), (BIG + 102, prose(rng, 9000), "en", "b", 60_000)]
    rows += [rows[3]] * 3  # repeated rows
    folder = f"{tmp_root}/ids"
    # one file: nulls share a batch with the large ids
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], i % 2, int(i % 5 == 0)) for i, r in enumerate(rows) if r[0] is not None][:30]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(BIG + i, f"u{i}", "<p>x</p>" * i) for i in range(5)] + [(None, None, None), (BIG + 9, None, "<p>x</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder, rows, pages


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n not in ("op9_warc_zstd", "op12_cover_tree_negatives", "op8_best_fit_pack")))
def test_ids_come_back_as_they_are(spark, tables, name):
    folder, rows, _ = tables
    got = Counter(r[0] for r in REGISTRY[name](spark, folder).select("doc_id").collect())
    assert got == Counter(r[0] for r in rows)


def test_ids_of_pages(spark, tables):
    folder, _, pages = tables
    got = Counter(r[0] for r in REGISTRY["op9_warc_zstd"](spark, folder).select("page_id").collect())
    assert got == Counter(r[0] for r in pages)


def test_packed_sequences(spark, tables):
    """Every id in one piece, pieces without gaps in sequences of at most a window, checksums of the true ids."""
    import numpy as np
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    folder, rows, _ = tables
    got = REGISTRY["op8_best_fit_pack"](spark, folder).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter()
    for i, text, *_ in rows:
        ids = np.asarray(encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


def test_rows_that_repeat_spread_over_groups(spark):
    cuts = spark.createDataFrame([(7, 0, 100, 5, 100)] * 3000, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    out = packing.pack(cuts, packing.Params(group=100)).collect()
    assert len(out) == 3000 and max(Counter(r.sequence_id >> 33 for r in out).values()) < 300


def test_edited_text_and_digest_columns(spark, tables):
    """The next document by (doc_id, text hash), the edit, its checksum and the likeness, by hand."""
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    order = [(r.doc_id, r.text or "") for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").orderBy("doc_id", "h").collect()]
    want = Counter()
    for (i, text), (_, follower) in zip(order, order[1:] + order[:1]):
        k = len(text) // 4
        edited = text[: len(text) - k] + follower[:k]
        want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest.digest(text), digest.digest(edited))] += 1
    got = REGISTRY["op2_quartile_digest"](spark, folder).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def slow_digest(text):
    """Counts of hashed byte triplets, quartile codes and length, byte by byte."""
    raw, counts, m = (text or "").encode(), [0] * 128, 0xFFFFFFFF

    def put(x, y, z, salt):
        h = ((x * 0x9E3779B1 & m) ^ (y * 0x85EBCA77 & m) ^ (z * 0xC2B2AE3D & m) ^ salt) * 0x27D4EB2F & m
        counts[h >> 25] += 1

    for i in range(len(raw)):
        if i + 2 < len(raw):
            put(raw[i], raw[i + 1], raw[i + 2], 11)
        if i + 3 < len(raw):
            put(raw[i], raw[i + 1], raw[i + 3], 53)
            put(raw[i], raw[i + 2], raw[i + 3], 97)
    q = [sorted(counts)[k] for k in (31, 63, 95)]
    codes = [sum(c > x for x in q) for c in counts]
    return "".join(f"{a << 6 | b << 4 | c << 2 | d:02x}" for a, b, c, d in zip(*(codes[k::4] for k in range(4))))


def test_digest_counts_every_triplet():
    rng = random.Random(13)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = "".join(rng.choice("abcdé ñ\n") for _ in range(n))
        assert digest.digest(text)[4:] == slow_digest(text)


def test_risk_is_the_non_negative_estimate():
    """Terms by their definition, gradients by differences."""
    import numpy as np

    rng = np.random.default_rng(14)
    xp, xu, w, prior = rng.integers(0, 2, (20, 5)), rng.integers(0, 2, (50, 5)), rng.normal(size=5), 0.2
    loss = lambda z: 1 / (1 + np.exp(z))  # noqa: E731  sigmoid loss of label +1 at margin z
    terms = lambda v: (prior * loss(xp @ v).mean(), loss(-(xu @ v)).mean() - prior * loss(-(xp @ v)).mean())
    a, b, ga, gb = toxicity.risk(w, xp, xu, prior)
    assert np.allclose((a, b), terms(w))
    for k in range(5):
        e = np.zeros(5)
        e[k] = 1e-6
        up, down = terms(w + e), terms(w - e)
        assert np.allclose((ga[k], gb[k]), [(x - y) / 2e-6 for x, y in zip(up, down)], atol=1e-6)


def test_score_reads_the_same_features_as_training():
    import numpy as np

    rng = random.Random(15)
    texts = [" ".join(rng.choice(["achlichab", "achlichcd", "achlicher", "ab", "stone", "idiot"]) for _ in range(rng.randrange(30))) for _ in range(40)]
    keys = sorted({int(b) for t in texts for b in toxicity.buckets(t)})
    model = toxicity.Linear({k: float(rng.random() - 0.5) for k in keys if rng.random() < 0.5}, -0.3)
    for t in [*texts, "", None]:
        z = sum(model.weights.get(int(b), 0.0) for b in toxicity.buckets(t)) - 0.3
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-z)))
