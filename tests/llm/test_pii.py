"""Personal data: base spans against the plain patterns, validators, context, odd rows."""

import hashlib
import random
import re
import time

import pytest

from lexmine.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def doubled(d):
    return sum(sum(map(int, str(2 * x))) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0


PASSES = {
    "email": lambda s: True,
    "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
    "card": lambda s: 16 <= len(digits(s)) <= 19 and doubled(digits(s)),
    "phone": lambda s: 8 <= len(digits(s)) <= 15,
}


def plain(text):
    return [(k, m.start(), m.end()) for k, x in PATTERNS.items() for m in re.finditer(x, text or "") if PASSES[k](m.group())]


def base(text):
    return [(s.kind, s.start, s.end) for s in pii.find(text) if s.base]


def added(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.find(text) if not s.base]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    for alphabet in ("a1.@+-( )%9é3_", "0123456789 -.", "ab@.-", "+1 2()5.-"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
            assert base(t) == plain(t), t


def card(rng, size, prefix):
    d = [*map(int, prefix), *(rng.randrange(10) for _ in range(size - len(prefix) - 1))]
    return "".join(map(str, next(d + [x] for x in range(10) if doubled(d + [x]))))


def test_random_cards_and_accounts():
    rng = random.Random(9)
    for _ in range(300):
        c = card(rng, 16, "4")
        wrong = c[:-1] + str((int(c[-1]) + 1) % 10)
        assert pii.luhn(c) and not pii.luhn(wrong)
        a = "".join(str(rng.randrange(10)) for _ in range(18))
        check = 98 - int(a + "131400") % 97  # D E 0 0
        assert pii.mod97(f"DE{check:02d}{a}") and not pii.mod97(f"DE{check:02d}{a[:-1]}{(int(a[-1]) + 1) % 10}")


@pytest.mark.parametrize("text,want", [
    ("Amex card 378282246310005 please", [("card", "378282246310005")]),
    ("pay by card: 4111 1111 1111 1111 12 27 now", [("card", "4111 1111 1111 1111")]),
    ("order 4111 1111 1111 1111 12 27 now", []),
    ("IBAN DE89 3704 0044 0532 0130 00.", [("iban", "DE89 3704 0044 0532 0130 00")]),
    ("IBAN DE89 3704 0044 0532 0130 01.", []),
    ("call me at (212) 555-0199 today", [("phone", "(212) 555-0199")]),
    ("Telefon 030 1234567", [("phone", "030 1234567")]),
    ("between 1990 2005 and 030 1234567", []),
    ("write to jane.doe [at] example [dot] org", [("email", "jane.doe [at] example [dot] org")]),
    ("her SSN 123-45-6789", [("ssn", "123-45-6789")]),
    ("SSN 666-45-6789", []),
    ("part 123-45-6789", []),
])
def test_added_spans(text, want):
    assert added(text) == want


def test_added_spans_leave_base_spans_and_each_other_alone():
    rng = random.Random(10)
    parts = ["card 4111 1111 1111 1111", "tel 030 1234567", "+49 30 123456", "a@b.co", "10.0.0.1", "x (at) y (dot) org", "IBAN DE89370400440532013000", "7", " "]
    for _ in range(3000):
        t = " ".join(rng.choice(parts) for _ in range(6))
        spans = pii.find(t)
        assert [(s.kind, s.start, s.end) for s in spans if s.base] == plain(t)
        for kind in pii.KINDS:
            own = sorted((s.start, s.end) for s in spans if s.kind == kind)
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:])), t


def test_redaction():
    t = "mail a@b.co or +1 (132) 555-1352, 10.0.0.1"
    assert pii.redacted(t, pii.find(t)) == "mail <EMAIL> or <PHONE>, <IP>"
    assert pii.redacted(None, []) is None


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("1" * 60_000, "a" * 60_000 + "@", "1." * 40_000, "A1" * 40_000, "a@" * 40_000, "(12) " * 12_000):
        pii.find(t)
    assert time.time() - began < 20


def test_rows_of_odd_tables(spark):
    rows = [(None, "a@b.co 10.0.0.1"), (1 << 60, None), ((1 << 60) + 1, ""), ((1 << 60) + 3, "é😀 +1 (132) 555-1352"), (3, "a@b.co"), (3, "a@b.co"), (4, "x " * 50_000 + "a@b.co")]
    docs = spark.createDataFrame([(i, t, "p", "s") for i, t in rows], "doc_id long, text string, redacted string, spans string")
    got = docs.select("doc_id", "text").join(pii.detect(docs).select("doc_id", "pii_spans", "redacted"), "doc_id")  # ids survive
    assert got.count() == 8
    out = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert set(out) == {i for i, _ in rows}
    assert [(s.kind, s.start, s.end) for s in out[(1 << 60) + 3].pii_spans] == [("phone", 3, 20)]
    assert out[None].redacted == "<EMAIL> <IP>" and out[1 << 60].redacted is None and out[4].pii_spans[0].start == 100_000
    assert pii.detect(docs.limit(0)).collect() == []


def test_query_columns(spark, tmp_root):
    folder = f"{tmp_root}/pii"
    rows = [(None, "a@b.co 10.0.0.1"), (5, None), ((1 << 60) + 1, "Amex card 378282246310005, +1 (132) 555-1352")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in pii.op13_pii_spans(spark, folder).collect()}
    for i, t in rows:
        want = plain(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert got[(1 << 60) + 1].spans == "card:10:25,phone:27:44" and got[5].spans == ""
