"""Landed web pages -> main-content text (and the article rows built from it)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmine.functions import html as H


@lru_cache(maxsize=1)
def _html_text(application: str) -> Column:
    """The main-text expression on column ``html``, built once per application (thousands of gateway calls)."""
    return H.main_text(F.col("html"))


def page_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(page_id, url, text, *keep)`` for every page, in one pass over ``pages`` (a null page has the text ``''``)."""
    text = _html_text(pages.sparkSession.sparkContext.applicationId)
    return pages.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"), *(keep or []))


def with_empty_flag(texts: DataFrame) -> DataFrame:
    """Empty text is not an error: the row stays, flagged."""
    return texts.withColumn("empty_body", F.col("text") == F.lit(""))
