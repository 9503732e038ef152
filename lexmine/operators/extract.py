"""Word extraction: the offline extractor, the pluggable extractor and the
post-filter of extracted words."""

from __future__ import annotations

import re
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.functions import text as T

VOCAB_COLUMNS = ["source_url", "pos", "word", "definition", "context_sentence"]


def sample_word_rows(articles: DataFrame, url_col: str = "url", text_col: str = "content") -> DataFrame:
    """``(source_url, pos, word)``: first five long alphabetic tokens per article."""
    return articles.select(
        F.col(url_col).alias("source_url"),
        F.posexplode(T.sample_words(F.col(text_col))).alias("pos", "word"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


def offline_extract(articles: DataFrame, url_col: str = "url", text_col: str = "content") -> DataFrame:
    """Offline extractor rows with the article URL attached as ``source_url``."""
    w = sample_word_rows(articles, url_col, text_col)
    return w.select(
        "source_url",
        "pos",
        "word",
        T.mock_definition(F.col("word")).alias("definition"),
        T.mock_context(F.col("word")).alias("context_sentence"),
    )


def filter_extracted(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Post-filter: drop words of 3 bytes or less and stop words; case kept."""
    return words.where(T.keep_extracted_word(F.col(word_col)))


EXTRACT_SCHEMA = (
    "source_url string, pos bigint, word string, definition string, "
    "context_sentence string, status string, error string"
)
EXTRACT_SCHEMA_COLS = [c.split()[0] for c in EXTRACT_SCHEMA.split(", ")]


def _text(value) -> str:
    """A field of an extracted word; anything but text rejects the article's answer."""
    if not isinstance(value, str):
        raise TypeError(f"{type(value).__name__} in place of text")
    return value


def _kept(word: str) -> bool:
    """The post-filter of :func:`filter_extracted`."""
    return len(word.encode("utf-8", "surrogatepass")) > T.FILTER_MIN_BYTES and word.lower() not in T.STOP_WORDS


def _answer(call: Callable[[], list[dict]]) -> list[tuple]:
    """``(pos, word, definition, context_sentence, status, error)`` of one article; never raises.

    All or nothing: a malformed entry rejects the answer.  An article without a kept word has one row without a word.
    """
    try:
        checked = [tuple(_text(w[k]) for k in ("word", "definition", "context_sentence")) for w in call()]
        return [(i, *w, "ok", None) for i, w in enumerate(checked) if _kept(w[0])] or [(None, None, None, None, "ok", None)]
    except Exception as e:  # noqa: BLE001 - failure becomes a status row
        return [(None, None, None, None, "llm_error", f"{type(e).__name__}: {e}")]


def register_extractor(
    spark: SparkSession, name: str, fn: Callable[..., list[dict]], setup: Callable[[], object] | None = None
) -> None:
    """Make ``fn`` the SQL table function ``name(text)``, for lateral joins with any table of texts::

        SELECT a.url, w.* FROM articles a, LATERAL name(a.content) w

    It returns ``(pos, word, definition, context_sentence, status, error)`` by the rules of :func:`extract_with`,
    in Arrow batches: at least one row per article (so the lateral join keeps every article), post-filtered words,
    failures as ``llm_error``.  A null text is an empty one.  ``setup()`` opens a client once per task; ``fn`` gets
    it as second argument.
    """
    from lexmine.session import ship_package

    ship_package(spark)

    class Extract:
        def __init__(self):
            self.client = (setup(),) if setup else ()

        def eval(self, text: str):
            yield from _answer(lambda: fn(text or "", *self.client))

    columns = EXTRACT_SCHEMA.split(", ", 1)[1]
    spark.udtf.register(name, F.udtf(Extract, returnType=columns, useArrow=True))


def extract_with(
    articles: DataFrame,
    fn: Callable[[str], list[dict]],
    url_col: str = "url",
    text_col: str = "content",
    setup: Callable[[], object] | None = None,
    rate_per_sec: float | None = None,
) -> DataFrame:
    """Pluggable extractor: ``fn(text) -> [{word, definition, context_sentence}]``.

    Runs with ``mapInPandas`` so any client is opened once per task
    (``setup()``; ``fn`` then gets it as a second argument), and never raises: a failing article yields one row with
    ``status='llm_error'`` and no word, so the article is still kept.  The
    words are filtered like the remote extractor's output and carry the
    article URL; an article of which no word is left has one row without a word.  ``rate_per_sec`` caps calls per task (a remote quota).
    Persist the result before use; extractors may be costly and
    non-deterministic.
    """
    import time

    from lexmine.session import ship_package

    ship_package(articles.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ctx = setup() if setup else None
        gap = 1.0 / rate_per_sec if rate_per_sec else 0.0
        last = 0.0
        for pdf in batches:
            out = []
            for url, text in zip(pdf[url_col], pdf[text_col]):
                if gap:
                    wait = last + gap - time.monotonic()
                    if wait > 0:
                        time.sleep(wait)
                    last = time.monotonic()
                args = (text or "",) if ctx is None else (text or "", ctx)
                out.extend((url, *row) for row in _answer(lambda: fn(*args)))
            yield pd.DataFrame(out, columns=EXTRACT_SCHEMA_COLS)

    return articles.select(F.col(url_col).alias(url_col), F.col(text_col).alias(text_col)).mapInPandas(run, EXTRACT_SCHEMA)


#: Unicode White_Space (``str.split`` also splits on \x1c to \x1f).
WHITE_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def sample_extractor(text: str) -> list[dict]:
    """Example user extractor (plain Python): the offline rule, word by word."""
    picked = [t for t in WHITE_SPACE.split(text or "") if len(t.encode()) > T.SAMPLE_MIN_BYTES and t.isalpha()]
    return [
        {"word": w, "definition": T.MOCK_DEFINITION.format(w=w), "context_sentence": T.MOCK_CONTEXT.format(w=w)}
        for w in (t.lower() for t in picked[: T.SAMPLE_MAX_WORDS])
    ]
