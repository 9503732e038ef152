"""Responses built by Spark from ``documents``: the landed input of the response queries.

One response per document.  Its answer lists every alphabetic token of the whole text, short and stop words too.
``doc_id mod 24`` picks the outcome: 0 remote HTTP error, 1 body not JSON, 2 remote error message, 3 no candidates,
4 empty parts, 5 text not JSON, 6 bare object, 7 missing key, 8 number as word, 9 extra key, 10 a candidate without
content, 11 a list as body, 12 text after the envelope; all others are good.

Not part of the library: jobs read response tables that a caller of the remote side landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.sources import corpus


def envelope(text: Column) -> Column:
    part = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
    return F.to_json(F.struct(F.array(F.struct(part.alias("content"))).alias("candidates")))


def assemble_responses(documents: DataFrame) -> DataFrame:
    """``(url, http_status, body)`` for every document that is an article."""
    art = corpus.articles_from_documents(documents, keep=["doc_id"])
    tokens = F.filter(T.split_ws(F.col("content")), T.is_alphabetic)
    words = F.transform(tokens, lambda w: F.struct(
        w.alias("word"), F.concat(F.lit("Definition of "), w).alias("definition"), F.concat(F.lit("The text has "), w).alias("context_sentence")))
    case = F.col("doc_id") % 24
    good = envelope(F.to_json(words))
    body = (
        F.when(case == 0, F.lit('{"error":{"message":"model overloaded"}}'))
        .when(case == 1, F.lit("upstream timeout"))
        .when(case == 2, F.lit('{"error":{"message":"quota exceeded"}}'))
        .when(case == 3, F.lit('{"candidates":[]}'))
        .when(case == 4, F.lit('{"candidates":[{"content":{"parts":[]}}]}'))
        .when(case == 5, envelope(F.concat(F.lit("Here are the words: "), F.array_join(tokens, ", "))))
        .when(case == 6, envelope(F.lit('{"word":"none"}')))
        .when(case == 7, envelope(F.to_json(F.transform(tokens, lambda w: F.struct(w.alias("word"), F.lit("d").alias("definition"))))))
        .when(case == 8, envelope(F.concat(F.lit('[{"word":'), F.col("doc_id").cast("string"), F.lit(',"definition":"d","context_sentence":"c"}]'))))
        .when(case == 9, envelope(F.to_json(F.transform(words, lambda o: F.struct(
            o["word"].alias("word"), o["definition"].alias("definition"), o["context_sentence"].alias("context_sentence"), F.lit("C1").alias("level"))))))
        .when(case == 10, F.lit('{"candidates":[{"finishReason":"SAFETY"}]}'))
        .when(case == 11, F.lit("[]"))
        .when(case == 12, F.concat(good, F.lit(" end")))
        .otherwise(good)
    )
    return art.select("url", F.when(case == 0, F.lit(503)).otherwise(F.lit(200)).alias("http_status"), body.alias("body"))
