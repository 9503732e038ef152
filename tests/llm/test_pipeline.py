"""The corpus pipeline, stage by stage on what its predecessor kept, against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from lexmine.llm import mixing, quality
from lexmine.llm.common import prepare
from test_spans import cut as cut_by
from lexmine.llm.spans import Params

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string"
BIG = (1 << 60) + 1


def prose(rng, n, base=0):
    return " ".join(f"w{base + rng.randrange(700)}" + ("." if rng.random() < 0.12 else "") for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_root):
    """Folder of the tables, the input rows, and every stage's result as written."""
    rng = random.Random(21)
    passage = prose(rng, 70, 5000)
    rows = [(i, prose(rng, 60 + i % 30), "en", "abc"[i % 3], 300) for i in range(60)]
    rows += [(100 + i, "buy now " * 40 + f"x{i}", "en", "b", 330) for i in range(20)]  # labelled bad below
    near = prose(rng, 200).split()
    rows += [(200 + i, " ".join(near[:100] + [f"e{i}"] + near[101:]), "en", "a", 900) for i in range(6)]  # near copies
    rows += [(300 + i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en", "c", 900) for i in range(5)]  # one passage
    rows += [(BIG, prose(rng, 80), "en", "a", 400), (None, prose(rng, 80), None, None, None), (BIG + 1, None, "en", "a", None), (BIG + 2, "", "en", "b", 0)]
    rows += [rows[0]] * 2 + [(1, rows[2][1], "en", "a", 300)]  # repeated rows, an id with two texts
    folder = f"{tmp_root}/pipeline"
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).coalesce(1)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    at, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, folder).write.parquet(f"{folder}/stage{k}")
        at = spark.read.parquet(f"{folder}/stage{k}")
        kept.append(at.collect())
    return folder, rows, kept


def plain(rows):
    return Counter(tuple(r)[:5] for r in rows)


def test_quality_stage_drops_the_rejected_rows_alone(spark, stages):
    folder, rows, kept = stages
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    prepare(spark)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), meta_cols=quality.META)
    good = [r for r in rows if model.margin(*quality.features(r[1], quality._meta({"n_chars": [r[4]]}, ["n_chars"], 1)[0])) >= -0.8472978603872036]
    assert plain(kept[0]) == plain(good)  # untouched, ids above 2^53 beside a null one included
    assert not {r.doc_id for r in kept[0]} & set(range(100, 120)) and {r.doc_id for r in kept[0]} >= set(range(60))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_one_document_of_every_group_of_near_copies_stays(stages):
    before, after = stages[2][0], stages[2][1]
    sets = [shingles(r.text) for r in before]
    root = list(range(len(before)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(before):
        groups.setdefault(find(k) if sets[k] else ("alone", k), []).append(r)
    left = plain(after)
    for group in groups.values():
        least = min((r.doc_id is None, r.doc_id or 0) for r in group)
        stay = [tuple(r)[:5] for r in group if left[tuple(r)[:5]]]
        assert len(set(stay)) == 1 and ((stay[0][0] is None), stay[0][0] or 0) == least, stay
    assert sum(left.values()) == len(groups)
    assert len([r for r in after if r.doc_id is not None and 200 <= r.doc_id < 206]) == 1


def test_repeated_passages_are_cut_by_the_rule(stages):
    before, after = stages[2][1], stages[2][2]
    assert len(before) == len(after) and Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    ordered = sorted((r.doc_id is None, r.doc_id or 0, k) for k, r in enumerate(before))  # no span is shared by rows of one id
    want = Counter()
    for (_, _, k), (_, gone, at, words) in zip(ordered, cut_by([(o, before[o[2]].text) for o in ordered], Params())):
        want[(before[k].doc_id, " ".join(w for n, (a, b) in enumerate(at) if n not in gone for w in words[a:b]))] += 1
    assert Counter((r.doc_id, " ".join((r.text or "").split())) for r in after) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    assert sum(len(r.text.split()) < 100 for r in after if r.doc_id is not None and 300 <= r.doc_id < 305) == 4


def test_mixture_comes_near_its_targets(stages):
    before, after = stages[2][2], stages[2][3]
    size = lambda r: len((r.text or "").split())
    words = Counter()
    for r in before:
        words[r.source] += size(r)
    goal = mixing.targets(list(words.items()))
    taken = Counter()
    for r in after:
        taken[r.source] += size(r)
    times, given = plain(after), plain(before)
    assert all(times[k] <= 2 * given[k] for k in times) and set(times) <= set(given)
    # no source is off its target by more than its smallest document
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(1, min(size(r) for r in before if r.source == s and size(r))), s


def test_packed_pieces_hold_every_token_once(stages):
    import numpy as np
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    before, after = stages[2][3], stages[2][4]
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter()
    for r in before:
        ids = np.asarray(encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[(r.doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in after) == want


def test_empty_corpus(spark, tmp_root):
    folder = f"{tmp_root}/pipeline-empty"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
