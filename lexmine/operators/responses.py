"""Remote-extractor tables: request bodies for a batch-inference run, and the
outcome and words of each stored response.

Transport is out of scope: requests are a table to hand to a batch client;
responses ``(url, http_status, body)`` are a landed table.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmine.functions import text as T

# ---------------------------------------------------------------------------
# Fixed values (request text and response-outcome messages)
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You are a strict TOEFL exam creator. Identify 3-5 distinct English words from the text that are "
    "CEFR Level C1 or C2. Ignore common words. Output a JSON list of objects with the following keys:\n"
    "- 'word': The lemma of the word.\n"
    "- 'definition': A concise academic definition.\n"
    "- 'context_sentence': The sentence from the text containing the word."
)
TARGET_SEPARATOR = "\n\nTarget Text:\n"
RESPONSE_MIME = "application/json"
# ---------------------------------------------------------------------------

# Texts of the outcomes.
ERR_HTTP = "remote call ended with status {status}: {body}"
ERR_REMOTE = "remote side reports: {message}"
ERR_ENVELOPE = "body is no answer envelope"
ERR_NO_CONTENT = "answer holds no text"
ERR_WORDS = "answer text is no list of words"

WORDS_SCHEMA = "array<struct<word:string,definition:string,context_sentence:string>>"
WORD_KEYS = ("word", "definition", "context_sentence")


def prompt(content: Column) -> Column:
    return F.concat(F.lit(SYSTEM_PROMPT + TARGET_SEPARATOR), content)


def requests(articles: DataFrame, url_col: str = "url", text_col: str = "content") -> DataFrame:
    """``(url, request)``: the JSON body of one generate call per article."""
    body = F.struct(
        F.array(F.struct(F.array(F.struct(prompt(F.col(text_col)).alias("text"))).alias("parts"))).alias("contents"),
        F.struct(F.lit(RESPONSE_MIME).alias("responseMimeType")).alias("generationConfig"),
    )
    return articles.select(F.col(url_col).alias("url"), F.to_json(body).alias("request"))


def _load(text: str):
    """Strict JSON: one value, no constants beyond the standard's, no field twice."""
    def no_constants(name):
        raise ValueError(name)

    def pairs(kv):
        keys = [k for k, _ in kv]
        if len(keys) != len(set(keys)):
            raise ValueError("duplicate key")
        return dict(kv)

    return json.loads(text, parse_constant=no_constants, object_pairs_hook=pairs)


def _strict_word_list(s: str | None) -> bool:
    """True when ``s`` is a JSON list of objects with the three string keys."""
    try:
        v = _load(s or "")
    except Exception:  # noqa: BLE001 - any decode failure means invalid
        return False
    return isinstance(v, list) and all(
        isinstance(o, dict) and all(isinstance(o.get(k), str) for k in WORD_KEYS) for o in v
    )


def _required(o, key: str, kind: type):
    """Field ``key`` of an object, of the given type."""
    if not isinstance(o, dict) or not isinstance(o.get(key), kind):
        raise ValueError(key)
    return o[key]


def _envelope(body: str | None) -> tuple[bool, str | None, str | None]:
    """(sound, message, text) of a response body.

    The body is an object; ``error`` is absent, null, or an object with a ``message`` text; ``candidates`` is absent,
    null, or a list in which every candidate has ``content`` with a list ``parts`` of objects with a ``text``.
    ``text`` is that of the first part of the first candidate, None if there is none.
    """
    try:
        v = _load(body or "")
        if not isinstance(v, dict):
            raise ValueError("object")
        message = None if v.get("error") is None else _required(v["error"], "message", str)
        texts = [] if v.get("candidates") is None else [
            [_required(part, "text", str) for part in _required(_required(c, "content", dict), "parts", list)]
            for c in _required(v, "candidates", list)]
    except Exception:  # noqa: BLE001 - any decode failure means invalid
        return False, None, None
    return True, message, texts[0][0] if texts and texts[0] else None


def _checked(bodies: pd.Series) -> pd.DataFrame:
    rows = []
    for body in bodies:
        sound, message, text = _envelope(body)
        rows.append((sound, message, text, text is not None and _strict_word_list(text)))
    return pd.DataFrame(rows, columns=["sound", "message", "text", "words_ok"])


def checked_body(body: Column) -> Column:
    """Arrow-batched strictness check (Spark's JSON readers are lenient): (sound, message, text, words_ok)."""
    return F.pandas_udf(_checked, "sound boolean, message string, text string, words_ok boolean")(body)


def outcomes(responses: DataFrame) -> DataFrame:
    """``(url, status, error, words_json)`` with the first failing rule winning:
    non-2xx, no envelope, remote error message, no text, bad word list.

    A null body is no envelope; a null status counts as failed.
    """
    from lexmine.operators.render import fill
    from lexmine.session import ship_package

    ship_package(responses.sparkSession)
    r = responses.select("url", F.col("http_status").cast("int").alias("http_status"), "body", checked_body(F.col("body")).alias("_c"))
    sound, message, text, words_ok = (F.col(f"_c.{x}") for x in ("sound", "message", "text", "words_ok"))
    http_ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    status = (
        F.when(~http_ok, "llm_error")
        .when(~sound, "parse_error")
        .when(message.isNotNull(), "llm_error")
        .when(text.isNull() | ~words_ok, "parse_error")
        .otherwise("ok")
    )
    error = (
        F.when(~http_ok, fill(ERR_HTTP, status=F.coalesce(F.col("http_status").cast("string"), F.lit("")), body=F.coalesce("body", F.lit(""))))
        .when(~sound, F.lit(ERR_ENVELOPE))
        .when(message.isNotNull(), fill(ERR_REMOTE, message=message))
        .when(text.isNull(), F.lit(ERR_NO_CONTENT))
        .when(~words_ok, F.lit(ERR_WORDS))
    )
    return r.select("url", status.alias("status"), error.alias("error"), F.when(status == "ok", text).alias("words_json"))


def response_words(outcome: DataFrame) -> DataFrame:
    """Words of the successful responses, in response order, unfiltered."""
    ok = outcome.where(F.col("status") == "ok")
    w = ok.select("url", F.posexplode(F.from_json("words_json", WORDS_SCHEMA)).alias("pos", "w"))
    return w.select(
        F.col("url").alias("source_url"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("w.word").alias("word"),
        F.col("w.definition").alias("definition"),
        F.col("w.context_sentence").alias("context_sentence"),
    )
