"""Small tests of the training-data operators: brute force, round trips, odd inputs."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lexmine.llm import digest, jaccard, licenses, lines, mixing, packing, quality, spans, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, u string, row string, h string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", "z") for i, t, s in rows], SCHEMA)


ODD = [(1, None, None), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "w " * 30, "b"), (5, "A b. " * 5000, "b")]


def words(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def test_machine_uses_the_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality.FactorMachine(40, 3, 1)
    m.w, m.w0 = rng.normal(size=40), 0.3
    idx, val = np.array([1, 5, 7, 30]), np.array([0.5, 1.0, 2.0, 0.1])
    pairs = sum(m.v[i] @ m.v[j] * a * b for k, (i, a) in enumerate(zip(idx, val)) for j, b in list(zip(idx, val))[k + 1 :])
    assert m.margin(idx, val) == pytest.approx(0.3 + m.w[idx] @ val + pairs, rel=1e-5)


def test_quality_and_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 60) + (" scum idiot" if i % 4 == 0 else ""), "s") if i % 3 else (i, "bad " * 60, "s") for i in range(400)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0 and i % 3 != 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    t = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(q[i].held_out for i in held) and sum(r.held_out for r in q.values()) == len(held)
    assert np.mean([q[i].predicted == (i % 3 != 0) for i in held]) > 0.9
    assert np.mean([t[i].predicted == (i % 4 == 0 and i % 3 != 0) for i in held]) > 0.9


def test_scores_of_odd_rows(spark):
    docs, none = frame(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (quality.score(docs, quality.train(docs, none)), toxicity.score(docs, toxicity.train(docs, none))):
        assert out.count() == len(ODD) and out.where("score is null or score < 0 or score > 1").count() == 0
        assert out.where("doc_id is null and held_out").count() == 1


def test_digest_pairs_follow_the_ids(spark):
    rng = random.Random(3)
    rows = [(i * 7 % 101, words(rng, rng.randrange(0, 80)), "s") for i in range(101)]
    got = {r.doc_id: r for r in digest.fingerprint_pairs(frame(spark, rows), 7).collect()}
    text = {i: t for i, t, _ in rows}
    for i in range(101):
        t, nxt = text[i], text[(i + 1) % 101]
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        assert got[i].fingerprint == digest.digest(t) and got[i].edited_fingerprint == digest.digest(edited)
        assert got[i].near_next == digest.likeness(digest.digest(t), digest.digest(nxt))
    assert digest.likeness(digest.digest("abc"), digest.digest("abc")) == 1.0
    assert digest.fingerprint_pairs(frame(spark, ODD)).count() == len(ODD)
    assert digest.fingerprint_pairs(frame(spark, [])).count() == 0


def test_line_rules_remove_frequent_lines(spark):
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 30)}\nShared  LINE here\n" + words(rng, 5), "h") for i in range(15)]
    rows += [(100 + i, "boiler plate of this host " + " ".join(f"x{k}" for k in range(20)) + "\n" + words(rng, 4), "h") for i in range(15)]
    got = {r.doc_id: r for r in lines.line_rules(frame(spark, rows + ODD)).collect()}
    assert got[0].removed_words == 3 and got[0].kept
    assert not got[100].kept and not got[100].base_failed
    assert got[5].n_repeat_words == 10000 and got[5].base_failed and got[1].n_words == 0
    assert lines.line_rules(frame(spark, ODD)).count() == len(ODD) and lines.line_rules(frame(spark, [])).count() == 0


def test_license_spans(spark):
    text = "Foo bar. Released under the MIT License. More words follow here."
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, [(7, text, "s")] + ODD)).collect()}
    m = got[7].matches[0]
    assert got[7].license == "MIT line" and m.coverage == 1.0 and text[m.start : m.end] == "Released under the MIT License"
    assert got[1].n_matches == 0


def test_targets_and_budget_fit(spark):
    rng = random.Random(5)
    for _ in range(50):
        lengths = {rng.randrange(1, 60): rng.randrange(1, 6) for _ in range(8)}
        total = sum(n * c for n, c in lengths.items())
        budget = rng.randrange(total + 1)
        reach = {0}
        for n, c in lengths.items():
            reach = {x + n * k for x in reach for k in range(c + 1)}
        got = mixing.fit_counts(lengths, budget, 8192)
        assert all(0 <= got[n] <= lengths[n] for n in lengths)
        assert 0 <= budget - sum(n * c for n, c in got.items()) <= 60
    rows = [(i, words(rng, rng.randrange(0, 40)), rng.choice(["a", "b", "c", None])) for i in range(300)]
    out = mixing.mix(frame(spark, rows)).collect()
    docs = {i: s for i, _, s in rows}
    goal = {docs[r.doc_id]: r.target for r in out}
    for s, t in goal.items():
        assert abs(sum(r.taken for r in out if docs[r.doc_id] == s) - t) <= 1
    assert sum(goal.values()) == pytest.approx(1.5 * sum(r.size for r in out))
    assert mixing.mixed(frame(spark, rows)).count() == sum(r.copies for r in out)
    assert mixing.mix(frame(spark, ODD)).count() == len(ODD) and mixing.mix(frame(spark, [])).count() == 0


def test_jaccard_components_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for g in range(25):
        base = words(rng, rng.choice([5, 9, 20, 60, 200])).split()
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(w), "s"))
    rows += [(1, None, "s"), (2, "", "s"), (3, "x y", "s"), (4, "X Y", "s")]
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame(spark, rows)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_best_fit_round_trip(spark):
    rng = random.Random(7)
    lengths = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
    number, offset = packing.best_fit(lengths, 100)
    used = {}
    for n, o, k in sorted(zip(number, offset, lengths)):
        assert used.get(n, 0) == o
        used[n] = o + k
    assert max(used.values()) <= 100
    rooms = []  # brute force: tightest window by linear search
    for k in lengths:
        fit = [r for r in rooms if r >= k]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 100) - k)
    assert len(rooms) == len(used)
    out = packing.pack(packing.pieces(frame(spark, ODD), public_tokenizers.path("byte_bpe_50k.json"))).collect()
    assert sum(r.length for r in out if r.doc_id == 5) == next(r.doc_tokens for r in out if r.doc_id == 5)
    assert max(r.length + r.offset for r in out) <= 2048


def test_warc_round_trip(spark, tmp_root):
    pages = spark.createDataFrame(
        [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", None), (None, "u", "same"), (5, "u", "é" * 90000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload_bytes == 4
    assert got[2].record_type == got[None].record_type == got[5].record_type == "response"
    assert got[5].payload_bytes == 180000 and got[3].payload_digest == warc.payload_digest(b"")
    assert warc.round_trip(pages.limit(0)).count() == 0
    with pytest.raises(warc.WarcError):
        warc.parse_record(warc.make_record(1, "u", b"abc", None, "d")[:-5])


def test_repeated_spans_are_cut(spark):
    rng = random.Random(8)
    passage = " ".join(" ".join(words(rng, 12).split()).capitalize() + "." for _ in range(6)) + " "
    text = lambda: " ".join(words(rng, 10) + "." for _ in range(4)) + " "
    rows = [(i, text() + passage + text(), "s") for i in range(5)]
    got = {r.doc_id: r for r in spans.remove_repeats(frame(spark, rows + [(50, None, "s"), (51, "", "s")])).collect()}
    assert passage in got[0].text and got[0].n_removed == 0 and got[50].text is None
    for i in range(1, 5):
        assert passage not in got[i].text and got[i].n_removed == 6
        assert "".join(rows[i][1][a.start : a.end] for a in got[i].removed) == passage


def test_ranked_vocabulary_gives_the_ids_of_the_tokenizer_file():
    path = public_tokenizers.path
    e = packing.Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    texts = ["", "plain words, it's 12 o'clock\n\n", "<|endoftext|> as text", " " * 9000 + "x", "x" * 50_000, "Grüße 日本語 كتاب 😀", "͸ unassigned", "a   b"]
    for text in texts + [t for _, t, _ in ODD if t]:
        assert list(e.ids(text)) == e.slow.encode(text, add_special_tokens=False).ids


def test_license_scan_is_that_of_every_position():
    rng, p = random.Random(10), licenses.Params()
    index = licenses.Index(licenses.TEMPLATES, p)
    for line in ("(c) 2020 X. All rights reserved.", "Licensed under CC BY 4.0", "Released under the new MIT licence"):
        assert len(index.scan("foo bar " + line + " and more")) == 1, line
    assert index.scan("All hats. All rights reserved.")[0]["start"] == 10
    hits = 0
    for _ in range(40):
        words = [rng.choice(["the", "foo", "all", "license", "under"]) for _ in range(rng.randrange(9))]
        for _ in range(rng.randrange(1, 4)):
            for w in rng.choice([w for w in index.words.values() if len(w) < 60]):
                if rng.random() < 0.9:
                    words += [w] + ["the"] * (rng.random() < 0.08)
            words += [f"x{rng.randrange(9)}" for _ in range(rng.randrange(6))]
        every = {n: range(-len(t) - p.band, len(words) + p.band) for n, t in index.words.items()}
        got = index.matches(words, index.starts(words))
        assert got == index.matches(words, every)
        hits += len(got)
    assert hits > 30


def test_one_row_of_every_component_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(11)
    rows = []
    for g in range(30):
        base = words(rng, 60).split()
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((rng.choice([None, rng.randrange(25), rng.randrange(1000)]), " ".join(w), rng.choice("ab")))
    rows += rows[:12] + [rows[0]] * 3 + [(None, "", "s"), (None, "", "s"), (3, None, "s"), (3, "unlike any other row", "s")]
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k])
    big = lambda i: 10**9 if i is None else i
    out = [tuple(r)[:2] + (r.source,) for r in jaccard.one_per_component(frame(spark, rows)).collect()]
    assert len(out) == len(groups)
    for g in groups.values():
        stays = [r for r in out if r in g]
        assert len([r for r in stays if r[1]]) == 1 or not g[0][1]
        assert all(big(r[0]) == min(big(x[0]) for x in g) for r in stays)
    later = spans.remove_repeats(jaccard.one_per_component(frame(spark, rows)))
    assert later.count() == len(groups)


def test_ids_are_those_of_the_untouched_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert 50256 in plain.encode("x <|endoftext|> y", add_special_tokens=False).ids
    for e in (packing.Encoder(path("byte_bpe_50k.json")), packing.Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))):
        for text in ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n", "<|endoftext |>", "<|ENDOFTEXT|> é", "plain"]:
            assert list(e.ids(text)) == plain.encode(text, add_special_tokens=False).ids


def test_archives_of_a_lost_attempt_are_not_read(spark, tmp_root):
    import shutil

    folder = f"{tmp_root}/warc-retry"
    docs = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(6)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(docs, folder)
    (path,) = [r.path for r in manifest.collect()]
    local = path.removeprefix("file:")
    shutil.copy(local, local.replace("-00000.warc", "-00001.warc"))  # what an attempt that ended early leaves
    assert warc.read_archives(spark, folder).count() == 12
    assert sorted(r.page_id for r in warc.read_archives(spark, folder, manifest=manifest).collect()) == list(range(6))
