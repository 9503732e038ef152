"""Landed payload bytes -> text, and the prolog of an XML document.

The charset is the byte-order mark's, else that of UTF-16 without a mark (a ``<`` beside a zero byte), else the one
that the XML declaration names, else UTF-8.  Known names: UTF-8, US-ASCII, ISO-8859-1, windows-1252, UTF-16 and its
two byte orders; a payload that names another one is null (no text).  Broken sequences become U+FFFD, as a
decoder that never fails gives them; a mark is no part of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECLARED = r"""(?is)\A\s*<\?xml\s[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']"""

#: What may stand before the root element: processing instructions, comments, a document type with its subset.
PROLOG = r"(?is)\A\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE(?:[^\[>\"']|\"[^\"]*\"|'[^']*')*+(?:\[(?:<!--.*?-->|[^\]\"']|\"[^\"]*\"|'[^']*')*+\]\s*)?>\s*)*+"
ROOT = PROLOG + r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)"

NAMES = {
    "utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "utf-8", "ascii": "utf-8", "iso-8859-1": "latin", "latin1": "latin", "iso_8859-1": "latin",
    "windows-1252": "windows", "cp1252": "windows", "utf-16be": "be", "utf-16le": "le", "utf-16": "utf-8",
}  # a payload that says UTF-16 in bytes of eight is none: its bytes decide


def _wide(units: Column) -> Column:
    """Text of big-endian UTF-16 given as hex digits; half pairs and a cut last unit become U+FFFD."""
    cut = F.when(F.length(units) % 4 == 2, F.concat(F.substring(units, 1, F.length(units) - 2), F.lit("FFFD"))).otherwise(units)
    spaced = F.regexp_replace(cut, "(.{4})", "$1 ")
    high = F.regexp_replace(spaced, r"D[89AB].. (?!D[C-F])", "FFFD ")
    low = F.regexp_replace(high, r"(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    return F.decode(F.unhex(F.replace(low, F.lit(" "), F.lit(""))), "UTF-16BE")


def decoded(payload: Column) -> Column:
    """Text of a binary payload."""
    digits = F.hex(payload)
    narrow = F.decode(payload, "ISO-8859-1")  # one character a byte: the declaration is ASCII in all narrow charsets
    head = F.substring(narrow, 1, 1024)
    name = F.lower(F.regexp_extract(head, DECLARED, 1))
    known = F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v)])
    swapped = F.regexp_replace(digits, "(..)(..)", "$2$1")
    marks = "".join(chr(c) for c in range(128, 160) if c not in (129, 141, 143, 144, 157))
    kind = (
        F.when(digits.startswith("EFBBBF"), "mark")
        .when(digits.startswith("FFFE") | digits.startswith("3C00"), "le")
        .when(digits.startswith("FEFF") | digits.startswith("003C"), "be")
        .when(name == "", "utf-8")
        .otherwise(F.element_at(known, name))
    )
    text = (
        F.when(kind.isin("utf-8", "mark"), F.make_valid_utf8(payload.cast("string")))
        .when(kind == "le", _wide(swapped))
        .when(kind == "be", _wide(digits))
        .when(kind == "latin", narrow)
        .when(kind == "windows", F.translate(narrow, marks, marks.encode("latin-1").decode("cp1252")))
    )
    return F.regexp_replace(text, "\\A\ufeff", "")


def root_element(text: Column) -> Column:
    """Local name of the root element ('' for a text that is no XML document)."""
    return F.regexp_extract(text, ROOT, 1)


def without_prolog(text: Column) -> Column:
    """The document from its root element on."""
    return F.regexp_replace(text, PROLOG, "")
