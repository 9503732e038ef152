"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark code from the same stated rules, over the
pre-registered parquet views (``documents``, ``pages``, ...).  Shared
derivations are CTE fragments below.
"""

from __future__ import annotations

# Unicode White_Space as an explicit class (RE2's \s is ASCII-only).
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ALPHA = r"[\p{L}\p{Nl}]+"
UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LO = "abcdefghijklmnopqrstuvwxyz"

ARTICLES = f"""
articles_v AS (
  SELECT 'doc://' || source || '/' || CAST(doc_id AS VARCHAR) AS url,
         substr(text, 1, 60) AS title,
         text AS content,
         CASE doc_id % 3 WHEN 0 THEN 'RSS' WHEN 1 THEN 'Manual' ELSE 'Youtube' END AS source,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS BIGINT)) AS published_at,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS BIGINT) + 6) AS collected_at
  FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL
)"""

SAMPLE = f"""
sample_v AS (
  SELECT url AS source_url, collected_at,
         list_transform(
           list_slice(
             list_filter(string_split_regex(content, '{WS}'),
                         lambda x: strlen(x) > 8 AND regexp_full_match(x, '{ALPHA}')),
             1, 5),
           lambda x: lower(x)) AS ws
  FROM articles_v
),
words_v AS (
  SELECT source_url, collected_at,
         CAST(unnest(range(len(ws))) AS BIGINT) AS pos,
         unnest(ws) AS word
  FROM sample_v
),
vocab_v AS (
  SELECT source_url, pos, word,
         'Mock definition for ''' || word || '''' AS definition,
         'This is a sample context sentence containing ' || word || '.' AS context_sentence,
         collected_at
  FROM words_v
)"""

BANK = f"WITH {ARTICLES},{SAMPLE}"


def like_contains(col: str, q: str) -> str:
    """SQLite LIKE '%q%' (ASCII folding, wildcards kept, no escape)."""
    return f"translate({col}, '{UP}', '{LO}') LIKE '%' || translate({q}, '{UP}', '{LO}') || '%' ESCAPE ''"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dlit(s: str) -> str:
    """DuckDB expression for a literal string (newlines as chr(10))."""
    pieces = s.split("\n")
    out = " || chr(10) || ".join(sql_str(x) for x in pieces)
    return f"({out})"


def dfill(template: str, **exprs: str) -> str:
    """Concatenate template literals and SQL expressions (``{name}``)."""
    out, lit, i = [], "", 0
    while i < len(template):
        if template.startswith("{{", i) or template.startswith("}}", i):
            lit += template[i]
            i += 2
        elif template[i] == "{":
            j = template.index("}", i)
            if lit:
                out.append(dlit(lit))
                lit = ""
            out.append(f"({exprs[template[i + 1:j]]})")
            i = j + 1
        else:
            lit += template[i]
            i += 1
    if lit:
        out.append(dlit(lit))
    return " || ".join(out)


def md5key(seed: str, alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return f"md5({sql_str(seed)} || '|' || {p}source_url || '|' || CAST({p}pos AS VARCHAR))"


def escape_md(x: str) -> str:
    return f"regexp_replace({x}, '([_*\\[\\]()~`>#+\\-=|{{}}.!])', '\\\\\\1', 'g')"


# Character references that occur in the given pages; the ampersand comes last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))



def decode_sql(x: str) -> str:
    for e, c in REFERENCES:
        x = f"replace({x}, {sql_str(e)}, {sql_str(c)})"
    return x


def page_text_sql() -> str:
    """Text between the tags of each page's only article, by cutting at every ``<`` and the next ``>``."""
    return f"""SELECT page_id, url, trim(regexp_replace({decode_sql("marked")}, '{WS}', ' ', 'g')) AS text FROM (
      SELECT page_id, url, array_to_string(list_transform(string_split(inner_html, '<'), lambda x: substr(x, strpos(x, '>') + 1)), ' ') AS marked FROM (
        SELECT page_id, url, CASE WHEN pos = 0 THEN '' ELSE substr(html, pos, strpos(lower(html), '</article') - pos) END AS inner_html FROM (
          SELECT page_id, url, coalesce(html, '') AS html, strpos(lower(coalesce(html, '')), '<article') AS pos FROM pages)))"""


def oracle_sql() -> dict[str, str]:
    from lexmine.plans import params as P

    q = {}
    q["vocab_extract"] = f"{BANK} SELECT source_url, pos, word, definition, context_sentence FROM vocab_v"
    q["sample_words"] = f"{BANK} SELECT source_url, pos, word FROM words_v"
    q["vocab_all"] = f"{BANK} SELECT word, definition, context_sentence, source_url FROM vocab_v"
    qs = sql_str(P.SEARCH_QUERY)
    q["vocab_search"] = (
        f"{BANK} SELECT word, definition, context_sentence, source_url FROM vocab_v "
        f"WHERE {like_contains('word', qs)} OR {like_contains('definition', qs)}"
    )
    from lexmine.operators import render as R

    BC = "word, definition, context_sentence, source_url"
    qv = "q(query) AS (VALUES " + ", ".join(f"({sql_str(x)})" for x in P.SEARCH_QUERIES) + ")"
    q["vocab_search_batch"] = (
        f"{BANK}, {qv} SELECT q.query, v.word, v.definition, v.context_sentence, v.source_url "
        f"FROM vocab_v v JOIN q ON ({like_contains('v.word', 'q.query')}) OR ({like_contains('v.definition', 'q.query')})"
    )
    long_word = f"list_filter(string_split_regex(text, '{WS}'), lambda x: strlen(x) > 8 AND regexp_full_match(x, '{ALPHA}'))[1]"
    q["vocab_search_table"] = f"""{BANK},
bq AS (SELECT item_id, substr(lower({long_word}), 3, 5) AS part FROM benchmark),
q AS (SELECT DISTINCT CASE WHEN item_id % 2 = 1 THEN translate(part, '{LO}', '{UP}') ELSE part END AS query FROM bq WHERE part IS NOT NULL)
SELECT q.query, v.word, v.definition, v.context_sentence, v.source_url
FROM vocab_v v JOIN q ON ({like_contains('v.word', 'q.query')}) OR ({like_contains('v.definition', 'q.query')})"""
    today = (
        "SELECT v.* FROM vocab_v v JOIN articles_v a ON v.source_url = a.url "
        "WHERE CAST(a.collected_at AS DATE) = DATE '{d}'"
    )
    q["vocab_today"] = f"{BANK} SELECT {BC} FROM ({today.format(d=P.AS_OF_DAY)})"
    q["vocab_orphans"] = (
        f"{BANK} SELECT {BC} FROM vocab_v v WHERE NOT EXISTS (SELECT 1 FROM articles_v a WHERE a.url = v.source_url)"
    )
    q["random_word"] = f"{BANK} SELECT {BC} FROM vocab_v ORDER BY {md5key(P.SEED)} LIMIT 1"
    picks = (
        f"SELECT CAST(collected_at AS DATE) AS day, CAST(row_number() OVER (PARTITION BY CAST(collected_at AS DATE) "
        f"ORDER BY {md5key(P.SEED)}, source_url, pos) AS BIGINT) AS pick, * FROM vocab_v"
    )
    q["daily_pick"] = f"{BANK} SELECT day, pick, {BC} FROM ({picks}) WHERE pick <= {P.MESSAGE_WORDS}"
    card = dfill("**{w}**\n\n*Definition:* {d}\n\n> {c}\n\nSource: {u}",
                 w="word", d="definition", c="context_sentence", u="source_url")
    q["vocab_cards"] = f"{BANK} SELECT source_url, pos, {card} AS card FROM vocab_v"
    sep = dlit(R.CARD_SEPARATOR)
    q["daily_digest"] = f"""{BANK},
cards AS (SELECT CAST(collected_at AS DATE) AS day, collected_at, source_url, pos, {card} AS card FROM vocab_v),
blocks AS (SELECT day, collected_at, source_url, string_agg(card, {sep} ORDER BY pos) AS block
           FROM cards GROUP BY day, collected_at, source_url),
counts AS (SELECT day, count(*) AS n FROM cards GROUP BY day),
days AS (SELECT DISTINCT CAST(collected_at AS DATE) AS day FROM articles_v)
SELECT d.day, NULL::TIMESTAMP AS part_at, NULL::VARCHAR AS part_url,
       CASE WHEN coalesce(c.n, 0) > 0 THEN {dfill(R.DIGEST_HEADER, n="CAST(c.n AS VARCHAR)")}
            ELSE {dlit(R.DIGEST_EMPTY)} END AS text
FROM days d LEFT JOIN counts c ON d.day = c.day
UNION ALL
SELECT day, collected_at, source_url, block FROM blocks"""
    vcard = dfill("**{w}**\n\n*Definition:* {d}\n\n> {c}\n\nSource: {u}",
                  w="v.word", d="v.definition", c="v.context_sentence", u="v.source_url")
    q["search_documents"] = f"""{BANK}, {qv},
hits AS (SELECT q.query, v.collected_at, v.source_url, v.pos, {vcard} AS card
         FROM vocab_v v JOIN q ON ({like_contains('v.word', 'q.query')}) OR ({like_contains('v.definition', 'q.query')})),
blocks AS (SELECT query, collected_at, source_url, string_agg(card, {sep} ORDER BY pos) AS block
           FROM hits GROUP BY query, collected_at, source_url)
SELECT query, collected_at AS part_at, source_url AS part_url, block AS text FROM blocks
UNION ALL
SELECT query, NULL::TIMESTAMP, NULL::VARCHAR, {dfill(R.SEARCH_EMPTY, q="query")}
FROM (SELECT DISTINCT query FROM q) WHERE query NOT IN (SELECT query FROM hits)"""
    question = dfill(R.QUIZ_QUESTION, w="word")
    js = lambda x: f"CAST(to_json({x}) AS VARCHAR)"
    qjson = dfill(
        '{{\n  "answer": {a},\n  "context": {c},\n  "question": {q},\n  "source": {s},\n  "type": {t},\n  "word": {w}\n}}',
        a=js("definition"), c=js("context_sentence"), q=js(question), s=js("source_url"),
        t=js(sql_str(R.QUIZ_TYPE)), w=js("word"),
    )
    quiz = (
        f"SELECT source_url, pos, {sql_str(R.QUIZ_TYPE)} AS type, word, {question} AS question, "
        f"definition AS answer, context_sentence AS context, source_url AS source, {qjson} AS quiz_json FROM vocab_v"
    )
    q["quiz_bank"] = f"{BANK} {quiz}"
    q["quiz_random"] = (
        f"{BANK} SELECT coalesce((SELECT quiz_json FROM ({quiz}) ORDER BY {md5key(P.SEED)} LIMIT 1), "
        f"{dlit(R.QUIZ_EMPTY)}) AS text"
    )
    stem = r"regexp_replace(word, '[^\p{L}\p{Nl}\p{N}\-_]', '', 'g')"
    note = dfill(R.NOTE_TEMPLATE, today=sql_str(P.NOTE_DATE), article_url="source_url", word="word",
                 definition="definition", context_sentence="context_sentence")
    q["notes"] = f"""{BANK},
n AS (SELECT {stem} || '.md' AS file, {note} AS content,
             row_number() OVER (PARTITION BY {stem} || '.md' ORDER BY collected_at DESC, source_url DESC, pos DESC) AS rn
      FROM vocab_v)
SELECT file, content FROM n WHERE rn = 1"""
    item = dfill(R.MESSAGE_ITEM, n="CAST(pick AS VARCHAR)", word=escape_md("word"),
                 definition=escape_md("definition"), sentence=escape_md("context_sentence"))
    msg = f"{dlit(R.MESSAGE_TITLE)} || string_agg({item}, '' ORDER BY pick)"
    q["daily_message"] = f"""{BANK}, p AS ({picks})
SELECT day, CAST(count(*) AS BIGINT) AS words_sent, {msg} AS text
FROM p WHERE pick <= {P.MESSAGE_WORDS} GROUP BY day"""
    days = f"days(day) AS (VALUES (DATE '{P.AS_OF_DAY}'), (DATE '{P.EMPTY_DAY}'))"
    q["message_outbox"] = f"""{BANK}, {days},
modes(mode) AS (VALUES ('today'), ('all'), ('test')),
today_rows AS (SELECT d.day, v.* FROM days d JOIN vocab_v v ON TRUE JOIN articles_v a ON v.source_url = a.url
               WHERE CAST(a.collected_at AS DATE) = d.day),
all_rows AS (SELECT d.day, v.* FROM days d JOIN vocab_v v ON TRUE),
cand AS (
  SELECT 'today' AS mode, * FROM today_rows
  UNION ALL SELECT 'all' AS mode, * FROM all_rows
  UNION ALL SELECT 'test' AS mode, * FROM today_rows
  UNION ALL SELECT 'test' AS mode, * FROM all_rows r
            WHERE NOT EXISTS (SELECT 1 FROM today_rows t WHERE t.day = r.day)),
p AS (SELECT *, row_number() OVER (PARTITION BY day, mode ORDER BY {md5key(P.SEED)}, source_url, pos) AS pick FROM cand),
m AS (SELECT day, mode, count(*) AS words_sent, {msg} AS text FROM p WHERE pick <= {P.MESSAGE_WORDS} GROUP BY day, mode)
SELECT g.day, g.mode, CAST(coalesce(m.words_sent, 0) AS BIGINT) AS words_sent,
       coalesce(m.words_sent, 0) = 0 AS skipped, m.text
FROM (SELECT * FROM days, modes) g LEFT JOIN m ON g.day = m.day AND g.mode = m.mode"""
    q["page_text"] = page_text_sql()
    q["empty_bodies"] = f"SELECT page_id, url, text = '' AS empty_body FROM ({page_text_sql()})"
    from lexmine.plans.oracle_ingest import ingest_sql

    q.update(ingest_sql())
    from lexmine.plans.oracle_responses import responses_sql

    q.update(responses_sql())
    return q
