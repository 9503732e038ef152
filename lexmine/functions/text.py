"""Column expressions for the text rules the engine relies on.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------

# Stop words dropped by the post-filter of extracted words, in the order the
# reference lists them (90 words).
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must",
    "can", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they",
    "what", "which", "who", "whom", "when", "where", "why", "how", "all", "each", "every",
    "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "just", "but", "and", "or", "if", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under",
)

# Characters escaped with a backslash in chat messages (18 characters).
MARKDOWN_SPECIALS = "_*[]()~`>#+-=|{}.!"

# Offline extractor: byte-length threshold, words per article, text templates.
SAMPLE_MIN_BYTES = 8          # keep tokens with more than 8 bytes
SAMPLE_MAX_WORDS = 5          # first 5 qualifying tokens
MOCK_DEFINITION = "Mock definition for '{w}'"
MOCK_CONTEXT = "This is a sample context sentence containing {w}."

# Post-filter of extracted words: keep words with more than 3 bytes.
FILTER_MIN_BYTES = 3

# ---------------------------------------------------------------------------

# Unicode White_Space (what a whitespace split uses); Java's \s is ASCII-only.
WS_REGEX = r"\p{IsWhite_Space}+"
ALPHA_TOKEN_REGEX = r"^\p{IsAlphabetic}+$"
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"


def split_ws(col: Column) -> Column:
    """Whitespace tokens of ``col`` (no empty tokens)."""
    return F.filter(F.split(col, WS_REGEX), lambda t: t != F.lit(""))


def normalize_ws(col: Column) -> Column:
    """Collapse runs of Unicode whitespace to one space and trim the ends."""
    return F.array_join(split_ws(col), " ")


def collapse_ws(col: Column) -> Column:
    """Same result as ``normalize_ws`` with one regex pass (no array)."""
    return F.trim(F.regexp_replace(col, WS_REGEX, " "))


def is_alphabetic(col: Column) -> Column:
    """True when every character is Unicode-alphabetic (and there is one)."""
    return col.rlike(ALPHA_TOKEN_REGEX)


def ascii_lower(col: Column) -> Column:
    """Lower-case ASCII letters only (SQLite ``LIKE`` folding)."""
    return F.translate(col, UPPER_ASCII, LOWER_ASCII)


# A whole whitespace-delimited token made only of alphabetic characters (at
# least 3: fewer can never exceed 8 bytes).
ALPHA_TOKEN_IN_TEXT = r"(?<![^\p{IsWhite_Space}])\p{IsAlphabetic}{3,}(?![^\p{IsWhite_Space}])"


def sample_words(text: Column) -> Column:
    """Array of the first 5 long alphabetic tokens, lower-cased, text order.

    One regex pass finds whole alphabetic tokens (same result as splitting on
    whitespace and testing each token, without building the token array).
    """
    tokens = F.filter(
        F.regexp_extract_all(text, F.lit(ALPHA_TOKEN_IN_TEXT), 0),
        lambda t: F.octet_length(t) > SAMPLE_MIN_BYTES,
    )
    return F.transform(F.slice(tokens, 1, SAMPLE_MAX_WORDS), lambda t: F.lower(t))


def mock_definition(word: Column) -> Column:
    head, tail = MOCK_DEFINITION.split("{w}")
    return F.concat(F.lit(head), word, F.lit(tail))


def mock_context(word: Column) -> Column:
    head, tail = MOCK_CONTEXT.split("{w}")
    return F.concat(F.lit(head), word, F.lit(tail))


def keep_extracted_word(word: Column) -> Column:
    """Post-filter predicate: more than 3 bytes and not a stop word."""
    return (F.octet_length(word) > FILTER_MIN_BYTES) & ~F.lower(word).isin(*STOP_WORDS)


def like_pattern(query: Column) -> Column:
    """Spark LIKE pattern for SQLite ``'%' || q || '%'`` (ASCII-folded, ``\\`` literal)."""
    return F.concat(F.lit("%"), F.replace(ascii_lower(query), F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def like_contains(col: Column, query: Column) -> Column:
    """SQLite ``col LIKE '%' || q || '%'`` semantics.

    ASCII-only case folding, ``%``/``_`` in ``q`` stay wildcards and there is
    no escape character (so a backslash in ``q`` is literal).  A null on
    either side gives null, as in SQL.
    """
    return F.like(ascii_lower(col), like_pattern(query))


def folded_contains(folded_col: Column, folded_query: Column, has_wildcard: Column, pattern: Column) -> Column:
    """``like_contains`` on pre-folded columns: a plain substring test when the
    query has no wildcard (no regex), LIKE otherwise."""
    return F.when(has_wildcard, F.like(folded_col, pattern)).otherwise(F.contains(folded_col, folded_query))


def escape_markdown(col: Column) -> Column:
    """Backslash before each MarkdownV2 special character."""
    cls = "".join("\\" + c for c in MARKDOWN_SPECIALS)
    return F.regexp_replace(col, f"([{cls}])", r"\\$1")


def json_string(col: Column) -> Column:
    """JSON string literal (with quotes) of ``col``."""
    return F.regexp_extract(F.to_json(F.array(col)), r"(?s)^\[(.*)\]$", 1)


def seeded_order_key(seed: str, *cols: Column) -> Column:
    """Deterministic pseudo-random order: md5 of seed and key columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]))


def file_stem(word: Column) -> Column:
    """Keep alphanumeric characters, ``-`` and ``_`` (note file names)."""
    return F.regexp_replace(word, r"[^\p{IsAlphabetic}\p{N}\-_]", "")
