"""SQL of another engine that gives the rows of the operators it can express."""

from __future__ import annotations

from .licenses import ENDS, OTHER, RULES, code, known_sentences
from .linededup import LOWER, MIN_DOCS, MIN_LENGTH, UPPER
from .mixing import MOST, SHARE, WEIGHTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CASES = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))

MIX_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(concat_ws('-', CAST(doc_id AS VARCHAR), 'mix')) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % {len(WEIGHTS)} {_CASES} END AS weight, {MOST} * source_size AS lim,
    (SELECT SUM(source_size) FROM s) AS whole FROM s),
step AS (
  SELECT 0 AS i, CAST([] AS BIGINT[]) AS capped
  UNION ALL
  SELECT i + 1, (SELECT list(w.place ORDER BY w.place) FROM w WHERE w.lim < w.weight * (
      SELECT ({SHARE} * max(v.whole) - coalesce(SUM(v.lim) FILTER (list_contains(capped, v.place)), 0))
        / SUM(v.weight) FILTER (NOT list_contains(capped, v.place)) FROM w v)
      OR list_contains(capped, w.place))
  FROM step WHERE i < 1000 AND EXISTS (
    SELECT 1 FROM w WHERE NOT list_contains(capped, w.place) AND w.lim < w.weight * (
      SELECT ({SHARE} * max(v.whole) - coalesce(SUM(v.lim) FILTER (list_contains(capped, v.place)), 0))
        / SUM(v.weight) FILTER (NOT list_contains(capped, v.place)) FROM w v))),
last AS (SELECT capped FROM step ORDER BY i DESC LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN list_contains((SELECT capped FROM last), place) THEN CAST(lim AS DOUBLE) ELSE weight * (
      SELECT ({SHARE} * max(v.whole) - coalesce(SUM(v.lim) FILTER (list_contains((SELECT capped FROM last), v.place)), 0))
        / SUM(v.weight) FILTER (NOT list_contains((SELECT capped FROM last), v.place)) FROM w v) END AS target
  FROM w),
o AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS aim,
    coalesce(SUM(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(
  CASE WHEN source_size > 0 THEN aim // source_size ELSE 0 END * size
  + greatest(least(aim - CASE WHEN source_size > 0 THEN aim // source_size ELSE 0 END * source_size - b, size), 0)
  AS BIGINT) AS taken FROM o"""

_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}')"

LINES_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= {MIN_LENGTH}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT k.doc_id, count(*) AS n_lines,
  count(*) FILTER (c.key IS NOT NULL AND k.doc_id < c.last_doc) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
    FILTER (c.key IS NULL OR k.doc_id >= c.last_doc), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(ROW_NUMBER() OVER (
    PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

_KNOWN = known_sentences()
_MAP = f"MAP([{', '.join(map(quoted, _KNOWN))}], [{', '.join(map(quoted, _KNOWN.values()))}])"
_CODES = ["".join(map(code, ids)) for _, ids in RULES]
_STEPS = ",\n".join(
    f"r{i + 1} AS (SELECT *, replace(t{i}, {quoted(c)}, '|') AS t{i + 1} FROM r{i})" for i, c in enumerate(_CODES)
)
_NAMES = " || ".join(
    f"list_resize(CAST([] AS VARCHAR[]), CAST((length(t{i}) - length(t{i + 1})) // {len(c) - 1} AS INT), {quoted(name)})"
    for i, (c, (name, _)) in enumerate(zip(_CODES, RULES))
)

LICENSE_SQL = f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), {quoted(ENDS)}),
    lambda s: {_MAP}[trim(regexp_replace(lower(s), '{OTHER}', ' ', 'g'), ' ')]), lambda i: i IS NOT NULL) AS ids
  FROM documents),
r0 AS (SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '') AS t0 FROM cut),
{_STEPS}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string({_NAMES}, ','), '') AS licenses FROM r{len(RULES)}"""
