"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op8_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM d
),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM s),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM pos WHERE i + 2 <= len(w)
),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM tri, (VALUES (0), (1), (2)) v(k) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
f AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) AS n_letters
  FROM s LEFT JOIN rep ON rep.doc_id = s.doc_id
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_letters < 40 * word_chars) AS kept
FROM b
"""

# The escaped length adds one code point for each control string of the template.
SQL["op10_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
s AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '</?turn')) + length('<turn role="' || role || '">') + 1 + 9 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

SQL["op5_warc_revisits"] = r"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS p, url, md5(coalesce(html, '')) AS d FROM pages),
rec AS (
  SELECT p * 3 AS id, 'response' AS kind, url, p * 10 AS at, CASE WHEN p % 13 = 0 THEN 503 ELSE 200 END AS status,
    '"' || d || '"' AS etag, 'text/html' AS ctype, 'day ' || (p % 28) AS dt, CASE WHEN p % 7 <> 0 THEN 'day ' || ((p + 1) % 28) END AS lm, 's1' AS server, d AS payload FROM p
  UNION ALL
  SELECT p * 3 + 1, 'revisit', url || '#again', p * 10 + 5, 304,
    CASE WHEN p % 3 = 0 THEN 'W/"' || d || '"' WHEN p % 5 = 0 THEN '"stale"' ELSE '"' || d || '"' END, 'text/plain', 'day ' || ((p + 2) % 28), NULL, 's2', NULL FROM p
  UNION ALL
  SELECT p * 3 + 2, 'revisit', regexp_replace(url, '^http:', 'https:'), p * 10 + 1000003, 304,
    NULL, NULL, 'day ' || ((p + 3) % 28), 'day ' || ((p + 1) % 28), 's3', NULL FROM p
),
b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM rec),
q AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
    lambda a: a <> '' AND string_split(a, '=')[1] NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref'))) AS args FROM b
),
c AS (
  SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical FROM q
),
hit AS (
  SELECT v.*, s.id AS sid, s.etag AS setag, s.ctype AS sctype, s.dt AS sdt, s.lm AS slm, s.server AS sserver, s.payload AS spayload,
    row_number() OVER (PARTITION BY v.id ORDER BY s.at DESC, s.id DESC) AS rn
  FROM c v LEFT JOIN c s ON s.kind = 'response' AND s.status = 200 AND s.canonical = v.canonical AND s.at < v.at
  WHERE v.kind = 'revisit'
),
st AS (
  SELECT *, CASE WHEN sid IS NULL THEN 'no_capture'
    WHEN etag IS NOT NULL AND setag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(setag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN lm IS NOT NULL AND slm IS NOT NULL THEN CASE WHEN lm = slm THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unconfirmed' END AS res
  FROM hit WHERE rn = 1
)
SELECT id AS record_id, canonical, CASE WHEN res = 'resolved' THEN sid END AS response_id, res AS status,
  CASE WHEN res = 'resolved' THEN concat_ws(chr(10), 'content-type: ' || sctype, 'date: ' || dt, 'etag: ' || coalesce(etag, setag), 'last-modified: ' || slm, 'server: ' || sserver)
    ELSE concat_ws(chr(10), 'content-type: ' || ctype, 'date: ' || dt, 'etag: ' || etag, 'last-modified: ' || lm, 'server: ' || server) END AS headers,
  CASE WHEN res = 'resolved' THEN spayload END AS payload
FROM st
"""

SQL["op1_near_vectors"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.m),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT c.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id
"""

SQL["op2_near_texts"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.m),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


def _spans(kind: str, pattern: str, option: str = "") -> str:
    """SQL of (doc_id, kind, m, a, b): every match of a pattern, with its place from the pieces between the matches."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, m, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT doc_id, ms, p, i, ms[i] AS m FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0{option}) AS ms, string_split_regex(t, '{pattern}'{option}) AS p FROM d) x, LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i) y) z"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr({_DIGITS}, length({_DIGITS}) + 1 - j, 1) AS INT) ELSE (CAST(substr({_DIGITS}, length({_DIGITS}) + 1 - j, 1) AS INT) * 2) // 10 + (CAST(substr({_DIGITS}, length({_DIGITS}) + 1 - j, 1) AS INT) * 2) % 10 END)) % 10 = 0"
_PII = [("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "true"), ("ip", "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"), ("card", "[0-9]([\\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"), ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")]

SQL["pii_base_spans"] = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(f"SELECT *, {i} AS o FROM ({_spans(k, p)}) f WHERE {ok}" for i, (k, p, ok) in enumerate(_PII))
    + ") SELECT d.doc_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in _PII)
    + ", sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + length(m)), ',' ORDER BY o, a), '')) AS base_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"
)
_SECRETS = [("assign", """(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
_SECRET_OK = ["length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8", "length(m) >= 16", "length(m) >= 32"]

# letters of the names in either case: RE2 would also fold two letters beyond ASCII (long s, Kelvin sign) into s and k
SQL["secrets_base_spans"] = (
    "WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(383) || chr(8490), chr(1) || chr(1)) AS t FROM documents), s AS ("
    + " UNION ALL ".join(f"SELECT *, {i} AS o FROM ({_spans(k, '(?i)' + p if k == 'assign' else p)}) f WHERE {ok}" for i, ((k, p), ok) in enumerate(zip(_SECRETS, _SECRET_OK, strict=True)))
    + ") SELECT d.doc_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _ in _SECRETS)
    + ", sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + length(m)), ',' ORDER BY a, o), '')) AS base_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"
)
