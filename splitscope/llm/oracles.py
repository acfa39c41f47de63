"""SQL twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

_RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "(word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}
_SOFT = ("symbols", "dup_lines", "word_length")


def _verdict(r: str) -> str:
    """Whether the lower bound of a host's shrunken rate is above the limit: the operator's steps, one by one."""
    m = f"(a.t_{r} / a.n_all)"
    within = f"({m} * (1 - {m}))"
    size = "(a.n_all - a.n_sq / a.n_all)"
    rho = f"coalesce((a.q_{r} - {m} * a.t_{r} - (a.k - 1) * {within}) / nullif({within} * ({size} - (a.k - 1)), 0), 0.0)"
    strength = f"(1 / greatest(1e-4, least(0.5, {rho})) - 1)"
    total = f"(h.n_docs + {strength})"
    rate = f"((h.f_{r} + {m} * {strength}) / {total})"
    return f"({rate} - 1.645 * sqrt({rate} * (1 - {rate}) / ({total} + 1))) > 0.3 AS bad_{r}"


QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
spans AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM spans QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, w.source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
hosts AS (SELECT source, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({c}) AS f_{r}" for r, c in _RULES.items())} FROM m WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT count(*) AS k, sum(n_docs)::DOUBLE AS n_all, sum(n_docs * n_docs)::DOUBLE AS n_sq, {", ".join(f"sum(f_{r})::DOUBLE AS t_{r}, sum(f_{r} * f_{r} / n_docs) AS q_{r}" for r in _SOFT)} FROM hosts),
bad AS (SELECT h.source, {", ".join(map(_verdict, _SOFT))} FROM hosts h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES["short"]} OR {_RULES["repeats"]}) AS base_failed,
       NOT ({_RULES["short"]} OR {_RULES["repeats"]} OR {" OR ".join(f"({_RULES[r]} AND coalesce(bad_{r}, false))" for r in _SOFT)}) AS kept
FROM m LEFT JOIN bad USING (source)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY w.doc_id, n.n
"""

TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (SELECT vec_id, min(x) AS x FROM whole WHERE len(x) = (SELECT max(len(x)) FROM whole) GROUP BY vec_id),
met AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM met)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 5
"""
