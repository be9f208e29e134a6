"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)),
    lambda i: array_to_string(w[i:i + 2], ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
each_way AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT each_way.b, r.c FROM r JOIN each_way ON each_way.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) m ON m.v = d.doc_id
"""

ORACLES["op4_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS r,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS x FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, x) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(x) + length('<|turn|><|says|><|end|>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op5_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    string_split(text, chr(10)) AS l FROM d),
win AS (
  SELECT u, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6),
    lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM w WHERE len(w) > 8),
twice AS (
  SELECT u, i FROM (SELECT *, count(*) OVER (PARTITION BY u, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT u, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS g(k) GROUP BY 1),
norm AS (
  SELECT u, source, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM w),
prints AS (
  SELECT u, source, raw, pos, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]', '0', 'g'),
    '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM norm),
digests AS (
  SELECT u, source, string_agg(substr(md5(line), 1, 16), '' ORDER BY pos) AS digest FROM prints GROUP BY ALL),
h AS (SELECT DISTINCT d.source, digest, substr(md5(line), 1, 16) AS h FROM prints JOIN digests d USING (u)),
often AS (
  SELECT source, h FROM (
    SELECT source, h, count(*) AS n FROM h WHERE h <> substr(md5(''), 1, 16) GROUP BY ALL) o
  JOIN (SELECT source, count(DISTINCT digest) AS docs FROM digests GROUP BY 1) s USING (source)
  WHERE n > 50 AND 100 * n > 5 * docs),
leftover AS (
  SELECT u, bool_or(o.h IS NOT NULL) AS changed,
    sum(CASE WHEN o.h IS NULL THEN len(list_filter(string_split_regex(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '')) ELSE 0 END) AS n
  FROM prints p LEFT JOIN often o ON p.source = o.source AND substr(md5(p.line), 1, 16) = o.h GROUP BY 1),
f AS (
  SELECT w.u, doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.u = w.u),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (changed AND (n < 20 OR 100 * n < 20 * n_words)) AS kept
FROM g JOIN leftover USING (u)
"""

ORACLES["op7_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
t AS (
  SELECT row_number() OVER (ORDER BY doc_id, no) AS u, doc_id, no,
    list_sort(list_distinct(w)) AS t FROM w),
long AS (SELECT * FROM t WHERE len(t) > 0),
c AS (SELECT t, min(u) AS first, len(t) AS n FROM long GROUP BY t),
tok AS (SELECT first, n, unnest(t) AS tok FROM c),
df AS (SELECT tok, count(*) AS df FROM tok GROUP BY 1),
pre AS (
  SELECT first, n, tok FROM (
    SELECT *, row_number() OVER (PARTITION BY first ORDER BY df, tok) AS k FROM tok JOIN df USING (tok))
  WHERE k <= n - (80 * n + 99) // 100 + 1),
cand AS (
  SELECT DISTINCT x.first AS x, y.first AS y, x.n AS nx, y.n AS ny
  FROM pre x JOIN pre y ON x.tok = y.tok AND x.first > y.first
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
inter AS (
  SELECT x, y, nx, ny, count(*) AS c FROM cand JOIN tok a ON a.first = x
  JOIN tok b ON b.first = y AND b.tok = a.tok GROUP BY ALL),
later AS (SELECT DISTINCT x FROM inter WHERE 100 * c >= 80 * (nx + ny - c)),
gone AS (
  SELECT doc_id, no FROM long JOIN c USING (t)
  WHERE long.u <> c.first OR c.first IN (SELECT x FROM later)),
g AS (SELECT doc_id, count(*) AS n, string_agg(no::VARCHAR, ',' ORDER BY no) AS r FROM gone GROUP BY 1)
SELECT d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::BIGINT AS n_lines,
  coalesce(g.n, 0) AS n_removed, coalesce(g.r, '') AS removed
FROM documents d LEFT JOIN g USING (doc_id)
"""

ORACLES["op9_maxscore"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 10
"""

# Exact links; the operator's bands miss one with a chance of about 4e-6.
ORACLES["op12_superminhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)),
    lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
each_way AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT each_way.b, r.c FROM r JOIN each_way ON each_way.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) m ON m.v = d.doc_id
"""

ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT u, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT u) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 2) // (n + 2 * v) AS p
  FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + 1000000000 * (c + 2) // (sum(c) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL) JOIN v USING (lang)),
between AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN between x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""
