"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from .secrets import BASE, EXTRA

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, CASE WHEN coalesce(text, '') = '' THEN [''] ELSE string_split(text, chr(10)) END AS lines FROM documents),
k AS (SELECT *, list_transform(lines, lambda x: {_ASCII_LOWER.format(f"trim(x, {_BLANKS})")}) AS keys FROM d),
common AS (SELECT key FROM (SELECT row_no, unnest(list_distinct(keys)) AS key FROM k) WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10),
lines AS (SELECT row_no, doc_id, unnest(lines) AS line, unnest(keys) AS key, generate_subscripts(lines, 1) AS i FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON c.key = l.key GROUP BY row_no, doc_id"""

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ') || ' '] ELSE [] END AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT s.doc_id, len(shingles) AS n_shingles, min(v) AS component_id, s.doc_id = min(v) AS kept FROM s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, shingles"""


def _secrets() -> str:
    quote = lambda p: p.replace("'", "''").replace(r"\x20", " ").replace("((?i)password|passwd|secret|token|api_?key)(?-i)", "((?i:password|passwd|secret|token|api_?key))")
    rules = " UNION ALL ".join(
        f"SELECT row_no, doc_id, {k} AS rank, '{kind}' AS kind, {least} AS least, string_split_regex(text, '{quote(pattern)}') AS p, regexp_extract_all(text, '{quote(pattern)}', 0) AS m, regexp_extract_all(text, '{quote(pattern)}', {group}) AS g FROM d"
        for k, (kind, pattern, group, least, _) in enumerate(BASE + EXTRA)
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
    r AS ({rules}),
    u AS (SELECT row_no, rank, kind, least, unnest(p) AS p, unnest(m) AS m, unnest(g) AS g, generate_subscripts(p, 1) AS i FROM r WHERE len(m) > 0),
    a AS (SELECT *, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY row_no, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u WINDOW w AS (PARTITION BY row_no, rank ORDER BY i)),
    f AS (SELECT row_no, rank, kind, start, kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(start + length(m) AS VARCHAR) AS span FROM a WHERE m IS NOT NULL AND length(g) >= least)
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
    FROM d LEFT JOIN f USING (row_no) GROUP BY row_no, doc_id"""


ORACLES = {"op2_line_dedup": LINE_DEDUP, "op5_near_dedup": NEAR_DEDUP, "op9_secret_scan": _secrets()}
