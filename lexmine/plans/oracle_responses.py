"""DuckDB oracle SQL for the remote-extractor tables and the pluggable extractor.

The outcome of each kind of response is stated directly; the words are those of the document.
"""

from __future__ import annotations

from lexmine.functions.text import STOP_WORDS
from lexmine.operators import responses as R
from lexmine.plans.oracle import ALPHA, ARTICLES, BANK, WS, dfill, sql_str


RESP = f"""WITH {ARTICLES},
base AS (
  SELECT url, CAST(regexp_extract(url, '([0-9]+)$', 1) AS BIGINT) % 24 AS kind,
         list_filter(string_split_regex(content, '{WS}'), lambda t: t <> '' AND regexp_full_match(t, '{ALPHA}')) AS toks
  FROM articles_v),
w AS (
  SELECT *, list_transform(toks, lambda x: {{'word': x, 'definition': 'Definition of ' || x, 'context_sentence': 'The text has ' || x}}) AS words
  FROM base),
outc AS (
  SELECT url, words, toks, kind,
    CASE WHEN kind IN (0, 2) THEN 'llm_error' WHEN kind IN (1, 3, 4, 5, 6, 8, 10, 11, 12) OR (kind = 7 AND len(toks) > 0) THEN 'parse_error' ELSE 'ok' END AS status,
    CASE WHEN kind = 0 THEN {dfill(R.ERR_HTTP, status="'503'", body=sql_str('{"error":{"message":"model overloaded"}}'))}
         WHEN kind IN (1, 10, 11, 12) THEN {sql_str(R.ERR_ENVELOPE)}
         WHEN kind = 2 THEN {dfill(R.ERR_REMOTE, message="'quota exceeded'")}
         WHEN kind IN (3, 4) THEN {sql_str(R.ERR_NO_CONTENT)}
         WHEN kind IN (5, 6, 8) OR (kind = 7 AND len(toks) > 0) THEN {sql_str(R.ERR_WORDS)} END AS error
  FROM w),
words AS (
  SELECT url AS source_url, CAST(pos AS BIGINT) AS pos, o.word AS word, o.definition AS definition, o.context_sentence AS context_sentence
  FROM (SELECT url, unnest(range(len(words))) AS pos, unnest(words) AS o FROM outc WHERE status = 'ok' AND kind <> 7))"""


def responses_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    prompt = sql_str(R.SYSTEM_PROMPT + R.TARGET_SEPARATOR).replace("\n", "' || chr(10) || '")
    q["llm_requests"] = (
        f"WITH {ARTICLES} SELECT url, to_json({{'contents': [{{'parts': [{{'text': {prompt} || content}}]}}], "
        f"'generationConfig': {{'responseMimeType': {sql_str(R.RESPONSE_MIME)}}}}})::VARCHAR AS request FROM articles_v"
    )
    q["llm_outcomes"] = f"{RESP} SELECT url, status, error FROM outc"
    q["llm_words"] = f"{RESP} SELECT * FROM words"
    stops = ", ".join(sql_str(s) for s in STOP_WORDS)
    q["words_filtered"] = f"{RESP} SELECT * FROM words WHERE strlen(word) > 3 AND lower(word) NOT IN ({stops})"
    q["extract_custom"] = f"""{BANK}
SELECT source_url, pos, word, definition, context_sentence, 'ok' AS status FROM vocab_v
UNION ALL
SELECT source_url, NULL, NULL, NULL, NULL, 'ok' FROM sample_v WHERE len(ws) = 0"""
    q["extract_sql"] = q["extract_custom"]
    return q
