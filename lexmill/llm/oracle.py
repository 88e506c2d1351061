"""DuckDB statements of the training-text queries that SQL can express, over whole tables."""

from __future__ import annotations

_LIVE = "QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY made_at DESC NULLS LAST) = 1"
_TRIM = "trim({0}, E' \\t\\r\\n\\x0b\\x0c')"


def _live(table: str, key: str, columns: str) -> str:
    return f"SELECT {columns} FROM {table} WHERE {key} IS NOT NULL {_LIVE.format(key=key)}"


_P1 = rf"""
WITH units AS (
  SELECT section_uid AS unit_id, text FROM ({_live("sections", "section_uid", "section_uid, text")})
  UNION ALL SELECT chunk_id, text FROM ({_live("chunks", "chunk_id", "chunk_id, text")})),
long AS (SELECT unit_id, {_TRIM.format("text")} AS t FROM units WHERE length({_TRIM.format("text")}) > 1200),
parts AS (
  SELECT unit_id,
    list_max(list_transform(string_split_regex(t, '\n[ \t\r]*\n'), lambda x: length({_TRIM.format("x")}))) AS p,
    list_max(list_transform(string_split_regex(regexp_replace(t, '([.;:])\s+([A-Z(])', '\1' || chr(10) || '\2', 'g'), '[\r\n]+'), lambda x: length({_TRIM.format("x")}))) AS s,
    list_max(list_transform(string_split_regex(t, '\s+'), lambda x: length(x))) AS w
  FROM long),
ordinals AS (
  SELECT section_uid FROM ({_live("chunks", "chunk_id", "chunk_id, section_uid, ordinal")}) WHERE section_uid IS NOT NULL
  GROUP BY section_uid
  HAVING NOT coalesce(min(ordinal) = 0 AND max(ordinal) = count(*) - 1 AND count(DISTINCT ordinal) = count(*), false))
SELECT unit_id, CASE WHEN p <= 1200 THEN 'paragraph' WHEN s <= 1200 THEN 'sentence' WHEN w <= 1200 THEN 'word' ELSE 'none' END AS finding FROM parts
UNION ALL SELECT section_uid, 'ordinals' FROM ordinals
"""

_P2 = rf"""
WITH live AS ({_live("chunks", "chunk_id", "chunk_id, doc_id, text")}),
words AS (SELECT chunk_id, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM live WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT chunk_id, doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT chunk_id, doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
sizes AS (SELECT chunk_id, count(*) AS n FROM grams GROUP BY chunk_id),
common AS (
  SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.chunk_id < b.chunk_id AND a.doc_id IS DISTINCT FROM b.doc_id
  GROUP BY 1, 2)
SELECT chunk_a, chunk_b FROM common JOIN sizes x ON x.chunk_id = chunk_a JOIN sizes y ON y.chunk_id = chunk_b
WHERE c / (x.n + y.n - c) >= 0.6 - 1e-12
"""

_P4 = rf"""
WITH live AS (
  SELECT chunk_id AS key, section_uid AS grp, text FROM ({_live("chunks", "chunk_id", "chunk_id, section_uid, text")})
  UNION ALL SELECT DISTINCT id, NULL, question FROM items WHERE id IS NOT NULL),
plain AS (SELECT key, grp, trim(regexp_replace(text, '[\s\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS t FROM live WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT key, grp, substr(t, i, 140) AS s
  FROM (SELECT key, grp, t, unnest(range(1, length(t) - 138)) AS i FROM plain WHERE length(t) >= 140)),
shared AS (SELECT key, grp, hash(s) AS h, s FROM windows WHERE hash(s) IN (SELECT hash(s) FROM windows GROUP BY 1 HAVING count(*) > 1))
SELECT DISTINCT a.key AS record_a, b.key AS record_b FROM shared a JOIN shared b
ON a.h = b.h AND a.s = b.s AND a.key < b.key AND (a.grp IS NULL OR b.grp IS NULL OR a.grp <> b.grp)
"""


_P2_GROUPS = rf"""
WITH RECURSIVE live AS ({_live("chunks", "chunk_id", "chunk_id, text")}),
words AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM live WHERE text IS NOT NULL),
sets AS (SELECT chunk_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM words WHERE len(w) >= 3),
classed AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY g) AS class_id, count(*) OVER (PARTITION BY g) AS copies, g FROM sets),
grams AS (SELECT chunk_id AS c, unnest(g) AS x, len(g) AS n FROM classed WHERE chunk_id = class_id),
near AS (SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.6 - 1e-12),
reach AS (SELECT a AS x, b AS y FROM near UNION SELECT reach.x, near.b FROM reach JOIN near ON near.a = reach.y),
groups AS (SELECT x AS class_id, least(x, min(y)) AS group_id FROM reach GROUP BY 1),
degree AS (SELECT a AS class_id, count(*) AS n_links FROM near GROUP BY 1)
SELECT chunk_id, class_id, coalesce(group_id, class_id) AS group_id, coalesce(n_links, 0) AS n_links FROM classed LEFT JOIN groups USING (class_id) LEFT JOIN degree USING (class_id) WHERE copies > 1 OR n_links > 0
"""

_P2_COUNTS = rf"""
WITH pairs AS ({_P2}), both_ways AS (SELECT chunk_a AS x, chunk_b AS y FROM pairs UNION ALL SELECT chunk_b, chunk_a FROM pairs),
alike AS (SELECT DISTINCT regexp_extract(x, '^(.*)#[^#]*$', 1) AS uid, regexp_extract(y, '^(.*)#[^#]*$', 1) AS other FROM both_ways),
it AS (SELECT * FROM items WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY built_at DESC NULLS LAST) = 1),
asked AS (SELECT 'candidate' AS kind, candidate_id::VARCHAR AS id, near_dups AS kept, [primary_uid] AS uids FROM candidates WHERE candidate_id IS NOT NULL
  UNION ALL SELECT 'item', id, near_duplicates_at_0_10, list_transform(gold_spans, lambda g: g.doc_id || ':' || g.section_path) FROM it),
found AS (SELECT kind, id, count(DISTINCT other) AS n FROM (SELECT kind, id, unnest(uids) AS uid FROM asked) JOIN alike USING (uid) GROUP BY 1, 2)
SELECT kind, id, kept, coalesce(n, 0) AS found FROM asked LEFT JOIN found USING (kind, id)
"""

_SPACE = r"[\s\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+".replace("{{", "{").replace("}}", "}")
_P4_SHARES = rf"""
WITH live AS (
  SELECT chunk_id AS key, text FROM ({_live("chunks", "chunk_id", "chunk_id, text")})
  UNION ALL SELECT DISTINCT id, question FROM items WHERE id IS NOT NULL),
plain AS (SELECT key, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS t FROM live WHERE text IS NOT NULL),
windows AS (SELECT key, i, substr(t, i, 140) AS s FROM (SELECT key, t, unnest(range(1, length(t) - 138)) AS i FROM plain WHERE length(t) >= 140)),
several AS (SELECT s FROM windows GROUP BY 1 HAVING count(DISTINCT key) > 1),
shared AS (SELECT key, i FROM windows JOIN several USING (s)),
parts AS (SELECT key, least(140, coalesce(lead(i) OVER (PARTITION BY key ORDER BY i) - i, 140)) AS n FROM shared),
sums AS (SELECT key, sum(n)::BIGINT AS n FROM parts GROUP BY 1)
SELECT key AS record, length(t)::INT AS chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(t) > 0 THEN coalesce(n, 0) / length(t) ELSE 0.0 END AS share FROM plain LEFT JOIN sums USING (key)
"""

_P4_LEAKS = rf"""
WITH pairs AS ({_P4}), mixed AS (SELECT CASE WHEN record_a LIKE 'gs-%' THEN record_a ELSE record_b END AS item_id FROM pairs WHERE (record_a LIKE 'gs-%') <> (record_b LIKE 'gs-%')),
per AS (SELECT item_id, count(*) AS n FROM mixed GROUP BY 1), ck AS (SELECT * FROM checks WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY checked_at DESC NULLS LAST) = 1)
SELECT item_id, coalesce(len(leaks) > 0, false) AS reported, coalesce(n, 0) > 0 AS found, coalesce(n, 0) AS chunks FROM ck FULL JOIN per USING (item_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p2_found": _P2, "p2_groups": _P2_GROUPS, "p2_counts": _P2_COUNTS, "p4_found": _P4, "p4_shares": _P4_SHARES, "p4_leaks": _P4_LEAKS}
