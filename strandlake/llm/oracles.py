"""DuckDB SQL with the same rows as the queries that SQL can express."""

from .line_templates import LEADING, LEAST_FIELD, LEAST_SENTENCE, QUARTERS
from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    holds = []
    for r in RULES:
        per = r.per or "1"
        if r.low is not None:
            holds.append(f"{r.value} >= {r.low}::double * {per}")
        if r.high is not None:
            holds.append(f"{r.value} <= {r.high}::double * {per}")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x
  FROM documents),
g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS gram FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, unnest([0, 1, 2]) AS u(k) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(x)::BIGINT AS n_lines,
         (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda y: lower(y) IN ({stop})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(holds)} AS kept
FROM b"""


#: Base32 of a digest: its 40 hexadecimal digits in eights of four digits each for five of them.
_BASE32 = (
    "list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
    "((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::BIGINT, 1)), 'string_agg', '')"
)
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5
  UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.b))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""


_TEMPLATES = rf"""
WITH x AS (
  SELECT doc_id, i, t[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL), unnest(range(1, len(t) + 1)) AS u(i)),
p AS (SELECT *, list_filter(string_split(regexp_replace(line, '([.!?][\x20\x09-\x0D]+)', '\1' || chr(30), 'g'), chr(30)), lambda y: y <> '') AS s FROM x),
u AS (
  SELECT doc_id, i, 0 AS j, line AS unit FROM p
  UNION ALL SELECT doc_id, i, j, s[j] FROM p, unnest(range(1, len(s) + 1)) AS v(j) WHERE len(s) > 1),
w AS (
  SELECT doc_id, i, j, list_filter(string_split_regex(unit, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS raw,
         list_filter(string_split_regex(regexp_replace(unit, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS general FROM u),
t AS (
  SELECT doc_id, i, j, len(raw) AS n, CASE WHEN 2 * len(list_filter(general, lambda y: y <> '<*>')) >= len(raw) THEN general ELSE raw END AS w
  FROM w WHERE len(list_filter(general, lambda y: y <> '<*>')) > 0 AND (j = 0 OR len(raw) >= {LEAST_SENTENCE})),
k AS (
  SELECT doc_id, i, j, n || ' W ' || array_to_string(w, ' ') AS leaf FROM t
  UNION ALL SELECT doc_id, i, j, n || ' F' || q || ' ' || array_to_string(list_concat(w[1:{LEADING} + (n - {LEADING}) * q // {QUARTERS}], ['<*>'], w[{LEADING} + (n - {LEADING}) * (q + 1) // {QUARTERS} + 1:]), ' ')
  FROM t, unnest(range(0, {QUARTERS})) AS v(q) WHERE j = 0 AND n >= {LEAST_FIELD}),
f AS (SELECT leaf, min(doc_id) AS first FROM k GROUP BY leaf HAVING count(DISTINCT doc_id) >= 2),
gone AS (SELECT DISTINCT doc_id, i, j FROM k JOIN f USING (leaf) WHERE doc_id <> first),
l AS (
  SELECT p.doc_id, p.i, any_value(line) AS line, any_value(s) AS s, coalesce(bool_or(j = 0), false) AS whole, coalesce(list(j) FILTER (j > 0), []) AS cut
  FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY p.doc_id, p.i),
o AS (
  SELECT doc_id, i, whole OR (len(cut) > 0 AND len(cut) = len(s)) AS lost, len(cut) AS n,
         CASE WHEN len(cut) = 0 THEN line ELSE array_to_string(list_transform(list_filter(range(1, len(s) + 1), lambda y: NOT list_contains(cut, y)), lambda y: s[y]), '') END AS line FROM l),
r AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped, coalesce(sum(n) FILTER (NOT lost), 0)::BIGINT AS n_cut,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '') AS text FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(n_cut, 0)::BIGINT AS n_cut, r.text
FROM documents d LEFT JOIN r USING (doc_id)"""


_BACKOFF = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
t AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c
      FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
a AS (SELECT a, count(*) AS n FROM t GROUP BY a),
b AS (SELECT b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b),
c AS (SELECT c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c),
s AS (
  SELECT t.doc_id, t.i, a.n AS a, b.n AS b, c.n AS c,
         lag(a.n) OVER x AS a1, lag(b.n) OVER x AS b1, (SELECT count(*) FROM t) AS words
  FROM t JOIN a ON a.a = t.a LEFT JOIN b ON b.b = t.b LEFT JOIN c ON c.c = t.c WINDOW x AS (PARTITION BY t.doc_id ORDER BY t.i)),
v AS (
  SELECT doc_id, CASE WHEN c >= 2 THEN ln(c / b1::DOUBLE)
                      WHEN b >= 2 THEN ln(b / a1::DOUBLE) + least(i - 2, 1) * ln(0.4::DOUBLE)
                      ELSE ln(a / words::DOUBLE) + least(i - 1, 2) * ln(0.4::DOUBLE) END AS v FROM s)
SELECT d.doc_id, count(v)::BIGINT AS n_words, round(sum(v) / count(v), 6) AS mean_log_score
FROM d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id"""


ORACLES = {"op7_stupid_backoff": _BACKOFF, "op8_line_templates": _TEMPLATES, "op3_ngram_jaccard_join": _JACCARD, "op6_warc": _WARC, "op4_quality_rules": _quality()}
