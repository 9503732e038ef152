"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from lexmine.llm import covertree, importance
from lexmine.llm.covertree import op12_cover_tree_negatives
from lexmine.llm.digest import op2_quartile_digest
from lexmine.llm.importance import op11_importance_resampling
from lexmine.llm.jaccard import op7_jaccard_join
from lexmine.llm.licenses import op5_license_scan
from lexmine.llm.lines import op4_line_frequency
from lexmine.llm.mixing import op6_budget_mix
from lexmine.llm.packing import op8_best_fit_pack
from lexmine.llm.pii import op13_pii_spans
from lexmine.llm.quality import op1_quality_fm
from lexmine.llm.spans import op10_sentence_spans
from lexmine.llm.toxicity import op3_toxicity_nnpu
from lexmine.llm.warc import op9_warc_zstd

REGISTRY = {
    f.__name__: f
    for f in (
        op1_quality_fm, op2_quartile_digest, op3_toxicity_nnpu, op4_line_frequency, op5_license_scan,
        op6_budget_mix, op7_jaccard_join, op8_best_fit_pack, op9_warc_zstd, op10_sentence_spans,
        op11_importance_resampling, op12_cover_tree_negatives, op13_pii_spans,
    )
}

_OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
words AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
win AS (
  SELECT r, i, array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS g,
         count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k
  FROM words),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE k = 8),
rep AS (
  SELECT r, sum(least(8, i - p)) AS n FROM (
    SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 8) AS p FROM twice WHERE c > 1) GROUP BY r),
raw AS (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (
  SELECT r, source, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
one AS (SELECT DISTINCT r, source, norm, len(string_split(norm, ' ')) AS n FROM ln),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
hot AS (
  SELECT o.source, o.norm FROM one o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source
  GROUP BY o.source, o.norm, h.docs HAVING count(*) > 10 AND count(*) > 0.02 * h.docs),
lost AS (
  SELECT o.r, sum(o.n) AS total, sum(CASE WHEN h.norm IS NULL THEN 0 ELSE o.n END) AS gone
  FROM one o LEFT JOIN hot h ON o.source IS NOT DISTINCT FROM h.source AND o.norm = h.norm GROUP BY o.r),
s AS (
  SELECT d.doc_id, len(d.w) AS n_words, length(array_to_string(d.w, '')) AS word_chars,
         length(d.t) - length(translate(d.t, '#*$%&|<>', '')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost.total, 0) AS total, CAST(coalesce(lost.gone, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND total - removed_words >= 0.5 * total AND total - removed_words >= least(20, total) AS kept,
       removed_words
FROM s
"""

_OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(doc_id, peer) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT walk.doc_id, pairs.b FROM walk JOIN pairs ON pairs.a = walk.peer)
SELECT walk.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(walk.peer) AS component_id
FROM walk LEFT JOIN n ON n.doc_id = walk.doc_id GROUP BY walk.doc_id
"""

_OP9 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, octet_length(b) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31)), 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN g ON p.h = g.h
"""

ORACLE_SQL = {
    "op4_line_frequency": _OP4, "op7_jaccard_join": _OP7, "op9_warc_zstd": _OP9,
    "op11_importance_resampling": importance.ORACLE_SQL, "op12_cover_tree_negatives": covertree.ORACLE_SQL,
}
