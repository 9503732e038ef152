"""Sentence spans against a word-by-word statement of the rule, and against all windows of 50 words."""

import random
import re

import xxhash

from lexmine.llm import spans
from lexmine.llm.spans import Params

SCHEMA = "doc_id long, text string, cuts string, key string, removed int, h string"


def cut(rows, p):
    """Sentences that go, per row in order of (doc_id, text hash order given): the rule, word by word."""
    seen, out = {}, []
    for place, text in rows:
        words, ends = [], []
        for line in (text or "").split("\n"):
            found = re.findall(r"[^\x20\x09-\x0D]+", line)
            words += found
            ends += [re.search(r"[.!?][\"')\]»”]*$", w) is not None for w in found]
            if found:
                ends[-1] = True
        low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in low]
        parts, at = [], 0
        for k, e in enumerate(ends):
            if e or k == len(ends) - 1:
                parts.append((at, k + 1))
                at = k + 1
        starts = []
        for a, b in parts:
            marks = [a]
            if b - a > p.long:
                for k in range(a, b):
                    before, after = h[max(0, k - p.around) : k], h[k + 1 : k + 1 + p.around]
                    if k > a and all(h[k] < x for x in before) and all(h[k] <= x for x in after):
                        marks.append(k)
            for x, y in zip(marks, marks[1:] + [b]):
                starts.append(x)
                while y - x >= 2 * p.long:
                    x += p.long
                    starts.append(x)
        starts.append(len(words))
        gone = set()
        m = len(starts) - 1
        for i in range(m):
            j = next((j for j in range(i, m + 1) if starts[j] - starts[i] >= p.words), None)
            if j is None:
                continue
            j = min(max(j, i + 2), m)
            first = seen.setdefault(tuple(low[starts[i] : starts[j]]), (place, i))
            if first != (place, i):
                gone.update(range(i, j))
        out.append((place, gone, [(starts[k], starts[k + 1]) for k in range(m)], words))
    return out


def corpus(rng):
    words = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    long = words(90).split()
    shout = " ".join(words(9).capitalize() + "!" for _ in range(8))
    rows = [(i, f"{words(30)} {' '.join(long[i : i + 70])} {words(20)}") for i in range(4)]  # cut in mid-sentence, no stops
    rows += [(10 + i, f"{words(7)}. {words(11)}?\n\n{shout}\t {words(25)}.") for i in range(4)]
    rows += [(20, "ea " * 300), (21, "x " + "ea " * 140), (22, " ".join(long[3:60])), (23, " ".join(long).upper() + ". " + words(7)), (24, ""), (25, None)]
    rows += [(26, words(40)), (27, f"É {shout}"), (28, (words(12) + ". ") * 9), (30, " ".join(long[:20])), (31, words(5) + " " + " ".join(long[:20]))]
    return rows


def test_removed_sentences_are_those_of_the_rule(spark):
    for seed in range(3):
        rng = random.Random(seed)
        rows = corpus(rng)
        rng.shuffle(rows)
        docs = spark.createDataFrame([(i, t, "c", "k", 1, "h") for i, t in rows], SCHEMA).repartition(3)
        got = {r.doc_id: r for r in spans.remove_repeats(docs).collect()}
        want = cut(sorted(rows), Params())
        assert len(got) == len(want)
        for i, gone, at, words in want:
            left = [w for k, (a, b) in enumerate(at) if k not in gone for w in words[a:b]]
            r = got[i]
            assert (r.text or "").split() == left and (r.n_sentences, r.n_removed) == (len(at), len(gone)), i
            text, kept, last = dict(rows)[i], [], 0
            for a in r.removed:
                kept.append(text[last : a.start])
                last = a.end
            assert r.text is None if text is None else "".join(kept) + text[last:] == r.text
        assert got[25].text is None and got[20].n_removed > 0


def test_passages_of_over_fifty_words_go_but_for_their_ends(spark):
    """Every later copy of a passage loses most of its words, the first copy and all else none."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, marks = [], []
    for k in range(30):
        passage = words(rng.randrange(51, 120))
        if k % 2:
            passage = [w + "." if rng.random() < 0.15 else w for w in passage]
        for c in range(3):
            before, after = words(rng.randrange(40)), words(rng.randrange(40))
            rows.append((3 * k + c, " ".join(before + passage + after)))
            marks.append((c, len(before), len(passage), len(before + passage + after)))
    docs = spark.createDataFrame([(i, t, "c", "k", 1, "h") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in spans.remove_repeats(docs).collect()}
    lost = []
    for (i, t), (c, at, size, total) in zip(rows, marks):
        kept = got[i].text.split()
        if c == 0:
            assert kept == t.split()
        else:
            lost.append((total - len(kept)) / size)
            assert kept[:at] == t.split()[:at] and (at + size == total or kept[-(total - at - size) :] == t.split()[at + size :])
    assert min(lost) > 0.5 and sum(lost) / len(lost) > 0.8


def test_rows_that_share_ids_or_repeat(spark):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    other = "so " + text
    big = (1 << 60) + 1
    rows = [(None, text), (big, text), (big + 1, text), (big + 1, text), (7, other), (7, text), (7, text), (None, other)]
    docs = spark.createDataFrame([(i, t, "c", "k", 1, "h") for i, t in rows], SCHEMA).coalesce(1)
    got = [(r.doc_id, r.n_removed > 0) for r in spans.remove_repeats(docs).select("doc_id", "n_removed").collect()]
    assert sorted((str(i), x) for i, x in got if i != 7) == sorted([("None", True), ("None", True), (str(big), True), (str(big + 1), True), (str(big + 1), True)])
    # of the rows with the smallest id one text is first; rows that are fully equal share its fate
    assert sorted(x for i, x in got if i == 7) in ([False, False, True], [False, True, True])
    assert spans.remove_repeats(docs.limit(0)).collect() == []
