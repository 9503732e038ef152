"""Personal data: patterns propose spans, checksum validators confirm them, nearby words adjust the score.

Base kinds, leftmost and non-overlapping per kind, kept as they stand: ``email``, ``ip`` (four parts of at most
255), ``card`` (16 to 19 digits that pass Luhn) and ``phone`` (a plus sign and 8 to 15 digits).  A failed base
match is dropped without a retry.

The method adds spans that overlap no base span of their kind.  Each proposal starts from the score of its
pattern; a passed validator raises it, a failed one drops the proposal; a word of the kind's context within
``reach`` code points raises it, a word that speaks of other numbers lowers it; from ``threshold`` on it counts:

* ``card``: 12 to 19 digits, in whole separator groups, that pass Luhn inside a longer or shorter run than the
  base rule takes, with an issuer's prefix and length;
* ``phone``: national forms without a plus sign, only beside a context word;
* ``email``: ``name (at) host (dot) tld`` with bracketed words;
* ``iban``: country code, check digits and account, of the country's length, confirmed by mod 97;
* ``ssn``: ``ddd-dd-dddd`` with valid areas, only beside a context word.

Positions are code points of the whole text, end exclusive.  Every pattern reads a text in linear time: runs
are bounded or taken whole, so long texts of digits or letters cost no more than others.

Defined results: a null text is the empty text and has no spans; equal texts have equal spans; rows that repeat
and null ids are results of their own, ids never pass through Python; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexmine.llm.common import documents, prepare

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


@dataclass(frozen=True)
class Params:
    """``reach``: code points before and after a proposal in which context words count."""

    reach: int = 48
    threshold: float = 0.6
    raised: float = 0.35
    lowered: float = 0.25


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUPS = re.compile(r"[0-9]+")

NATIONAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)[ ]?|[0-9]{2,5}[ ./-])[0-9]{2,8}(?:[ ./-][0-9]{2,5}){0,3}(?![\w-])")
SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]{0,2}[\[({](?:at|AT)[\])}][ ]{0,2}[A-Za-z0-9-]{1,63}"
                   r"(?:[ ]{0,2}(?:[\[({](?:dot|DOT)[\])}]|\.)[ ]{0,2}[A-Za-z0-9-]{1,63}){1,4}")
SPELT_AT = re.compile(r"[\[({](?:at|AT)[\])}]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")

# Lengths of account numbers by country code.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}

# First digits and lengths of issuers.
ISSUERS = (
    (re.compile(r"4"), (13, 16, 19)),
    (re.compile(r"5[1-5]|2(?:2[2-9]|[3-6]|7[01]|720)"), (16,)),
    (re.compile(r"3[47]"), (15,)),
    (re.compile(r"3(?:0[0-5]|[68])"), (14,)),
    (re.compile(r"6(?:011|5|4[4-9])"), (16, 19)),
    (re.compile(r"35"), (16,)),
)

# Words beside a span that speak for its kind, in the four languages of the corpus.
CONTEXT = {
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta", "cvv", "cvc"),
    "phone": ("phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "handy", "anruf", "téléphone", "portable", "teléfono", "móvil"),
    "email": ("email", "mail", "contact", "kontakt", "courriel", "correo"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
# Words beside a span of digits that speak for another kind of number.
AGAINST = ("isbn", "issn", "doi", "version", "order", "invoice", "tracking", "serial", "sku", "page", "pp")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Sum of the digits, every second one from the right doubled less nine, divides by ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The account with its first four characters moved last, letters as numbers from 10, leaves 1."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def issued(digits: str) -> bool:
    return any(len(digits) in sizes and prefix.match(digits) for prefix, sizes in ISSUERS)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            done = host.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds."""
    out = [Span("email", a, b, 1.0, True) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
            out.append(Span("ip", m.start(), m.end(), 1.0, True))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", m.start(), m.end(), 1.0, True))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(Span("phone", m.start(), m.end(), 1.0, True))
    return out


def proposals(text: str) -> Iterator[Span]:
    """Spans beyond the base rules whose validator, where they have one, confirms them; scores without context."""
    for m in CARD.finditer(text):
        groups = [(g.start(), g.end()) for g in GROUPS.finditer(text, m.start(), m.end())]
        i = 0
        while i < len(groups):
            digits, best = "", 0
            for j in range(i, len(groups)):
                digits += text[groups[j][0] : groups[j][1]]
                if len(digits) > 19:
                    break
                if len(digits) >= 12 and issued(digits) and luhn(digits):
                    best = j + 1
            if best:
                # a whole run is likelier a card than a part of a run of groups
                yield Span("card", groups[i][0], groups[best - 1][1], 0.6 if best - i == len(groups) else 0.3, False)
            i = best or i + 1
    for m in NATIONAL.finditer(text):
        if 7 <= sum("0" <= c <= "9" for c in m.group()) <= 12:
            yield Span("phone", m.start(), m.end(), 0.3, False)
    if SPELT_AT.search(text):
        for m in SPELT.finditer(text):
            yield Span("email", m.start(), m.end(), 0.6, False)
    for m in IBAN.finditer(text):
        size = IBAN_LENGTHS.get(m.group()[:2])
        account, end = "", m.start()
        for c in m.group():
            end += 1
            account += c.strip()
            if len(account) == size:
                break
        whole = end == len(text) or not (text[end].isascii() and text[end].isalnum())
        if size == len(account) and whole and mod97(account):
            yield Span("iban", m.start(), end, 0.9, False)
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield Span("ssn", m.start(), m.end(), 0.3, False)


def in_context(text: str, s: Span, p: Params) -> float:
    """Score of a proposal after the words around it."""
    near = {w.lower() for w in WORD.findall(text[max(0, s.start - p.reach) : s.start] + " " + text[s.end : s.end + p.reach])}
    return s.score + p.raised * (not near.isdisjoint(CONTEXT[s.kind])) - p.lowered * (not near.isdisjoint(AGAINST))


def find(text: str | None, p: Params = Params()) -> list[Span]:
    """All spans of a whole text, by kind as listed in :data:`KINDS`, then by start."""
    text = text or ""
    if "@" not in text and not GROUPS.search(text) and not SPELT_AT.search(text):
        return []
    found = base_spans(text)
    taken = {k: [(s.start, s.end) for s in found if s.kind == k] for k in KINDS}
    numbers = taken["ip"] + taken["card"] + taken["phone"]
    for s in proposals(text):
        score = in_context(text, s, p)
        # digits that a confirmed span holds already are not proposed again as another kind
        held = taken["email"] if s.kind == "email" else numbers + taken["iban"] + taken["ssn"]
        if score >= p.threshold and all(s.end <= a or b <= s.start for a, b in held):
            found.append(s._replace(score=min(1.0, score)))
            taken[s.kind].append((s.start, s.end))
            if s.kind in ("card", "phone"):
                numbers.append((s.start, s.end))
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    if text is None:
        return None
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= last:
            out += [text[last : s.start], f"<{s.kind.upper()}>"]
            last = s.end
    return "".join(out) + text[last:]


SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def detect(docs: DataFrame, p: Params = Params(), text: str = "text") -> DataFrame:
    """``docs`` with the columns ``pii_spans`` and ``redacted`` (replaced where the input has them)."""
    prepare(docs.sparkSession)

    @F.pandas_udf(f"pii_spans {SPANS}, redacted string")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [find(t, p) for t in texts]
        return pd.DataFrame({"pii_spans": [[s._asdict() for s in f] for f in found],
                             "redacted": [redacted(t, f) for t, f in zip(texts, found)]})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("pii_spans", "redacted")]
    return docs.select(*kept, run(F.col(text)).alias("__pii")).select(*kept, "__pii.pii_spans", "__pii.redacted")


def listed(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def op13_pii_spans(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, per document."""
    prepare(spark)
    params = Params()

    @F.pandas_udf(", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = find(t, params)
            base = [s for s in found if s.base]
            rows.append((*(sum(s.kind == k for s in base) for k in BASE), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return documents(spark, sf_dir).select("doc_id", run("text").alias("x")).select("doc_id", "x.*")
