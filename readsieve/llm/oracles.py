"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), placed AS (
  SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM split
), lines AS (
  SELECT doc_id, pos, l[pos] AS line,
         trim(translate(l[pos], '{_UPPER}', '{_UPPER.lower()}'), {_BLANKS}) AS key
  FROM placed
), owners AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT doc_id, pos, line, owner IS NOT NULL AND owner <> doc_id AS lost
  FROM lines LEFT JOIN owners USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), digits AS (
  SELECT hex, array_to_string(list_transform(range(0, 8), lambda i:
    array_to_string(list_transform(range(0, 4), lambda j:
      substr('{_BASE32}', (((('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1), 1)), '')), '') AS digest
  FROM (SELECT DISTINCT hex FROM hashed)
), latest AS (
  SELECT hex, max(page_id) AS last FROM hashed GROUP BY hex
)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM hashed JOIN digits USING (hex) JOIN latest USING (hex)
"""

_ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
).replace("'", "''")
_KINDS = [
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("owned", "[A-Za-z0-9_-]{20,}", 0, 20),
]
_PARTS = " UNION ALL ".join(
    f"""
  SELECT doc_id, source, {n} AS kind, {least} AS least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals FROM (
    SELECT doc_id, source, regexp_split_to_array(text, '{pattern}') AS gaps,
           regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals
    FROM documents WHERE regexp_matches(text, '{pattern}'))"""
    for n, (_, pattern, group, least) in enumerate(_KINDS)
)

SECRETS = f"""
WITH parts AS ({_PARTS}
), placed AS (
  SELECT doc_id, source, kind, least, vals[i] AS val, length(hits[i]) AS long,
         sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM parts
), spans AS (
  SELECT doc_id, source, kind, val, (stop - long)::BIGINT AS start, stop::BIGINT AS stop FROM placed
  WHERE length(val) >= least
    AND (kind < 3 OR (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')))
), candidates AS (
  SELECT * FROM spans s WHERE kind < 3 OR NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = s.doc_id AND b.kind < 3 AND b.start < s.stop AND b.stop > s.start)
), owners AS (
  SELECT val, count(*) AS n_repositories, count(DISTINCT owner) AS n_owners
  FROM (SELECT DISTINCT val, coalesce(source, chr(0)) AS owner, doc_id FROM candidates) GROUP BY val
), named AS (
  SELECT *, n_owners < 3 AND n_repositories < 5 AS live, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS label
  FROM candidates JOIN owners USING (val)
), found AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples,
         max(n_repositories) AS most_repositories, max(n_owners) AS most_owners
  FROM named GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples,
       coalesce(most_repositories, 0) AS most_repositories, coalesce(most_owners, 0) AS most_owners
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""

ORACLES: dict[str, str] = {"op5_warc": WARC, "op8_line_dedup": LINE_DEDUP, "op9_secrets": SECRETS}
