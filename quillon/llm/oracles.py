"""SQL that checks the operators whose results SQL can express."""

from __future__ import annotations

from .chat_format import CONTROL, END, MESSAGE, START
from .quality_rules import MAX_REPEATED_PERCENT, MIN_WORDS, RULES, STOP_WORDS, WINDOW

_WORD = r"'[^\x20\x09-\x0D]+'"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, {_quote(c)}, {_quote(c[0] + chr(92) + c[1:])})"
    return out


OP3 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum({len(START) + len(MESSAGE) + len(END)} + length({_escape("role")}) + length({_escape("text")})) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _rules() -> str:
    tests = []
    for _, over, under, least, most in RULES:
        ratio = f"(CASE WHEN {under} > 0 THEN {over}::DOUBLE / {under} ELSE 0 END)"
        tests += [f"{ratio} >= {least}"] * (least is not None) + [f"{ratio} <= {most}"] * (most is not None)
    return " AND ".join(tests)


OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
v AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM v),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM c CROSS JOIN range({WINDOW}) o(j) WHERE k > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(map(_quote, dict.fromkeys(STOP_WORDS)))})))::BIGINT AS n_stop_words FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept FROM b
"""

OP10 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM x JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 75 * (u.k + v.k - shared)),
y AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM y UNION SELECT r.a, y.b FROM r JOIN y ON y.a = r.b),
c AS (SELECT a, min(b) AS lo FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.lo, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""


def _record(body: str) -> str:
    crlf = "chr(13) || chr(10)"
    return (
        f"'WARC/1.0' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Date: 2024-01-01T00:00:00Z' || {crlf} || 'WARC-Record-ID: <urn:sha256:' || sha256(u || chr(10) || {body}) || '>' || {crlf} || 'WARC-Target-URI: ' || u || {crlf}"
        f" || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || strlen({body}) || {crlf} || {crlf} || {body} || {crlf} || {crlf}"
    )


OP8 = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN '#' || substr(html, 2) ELSE coalesce(html, '') END AS h2 FROM pages),
r AS (SELECT page_id, {_record("h")} AS rec, {_record("h2")} AS rec2 FROM p),
o AS (SELECT page_id, 'part-' || lpad(CAST(page_id // 500 AS VARCHAR), 8, '0') || '.warc' AS file, strlen(rec)::BIGINT AS length, sha256(rec) AS sha256, sha256(rec2) AS other FROM r),
f AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY page_id) - length)::BIGINT AS "offset" FROM o)
SELECT page_id, file, "offset", length, CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'corrupt' END AS status, sha256 FROM f WHERE page_id % 101 = 7 OR sha256 <> other
"""

ORACLES = {"op3_chat_format": OP3, "op8_warc_fixity": OP8, "op9_quality_rules": OP9, "op10_ngram_join": OP10}
