"""The registered queries again, as SQL for DuckDB.

The SQL is assembled from the same fixed values but shares no code with the
Spark expressions.
"""

from __future__ import annotations

from .functions import fixed_values as fv
from .queries import SCANNED_TABLES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# --- hash and replacement values --------------------------------------------------------

BASIS = (fv.FNV_OFFSET_HI << 32) + fv.FNV_OFFSET_LO
TWO64 = "18446744073709551616::HUGEINT"


def fnv(col: str, salt: str = "0") -> str:
    return (
        f"list_reduce(list_prepend((({BASIS}::HUGEINT) + ({salt})::HUGEINT) % {TWO64}, "
        f"list_transform(range(1, octet_length(encode({col})) + 1), "
        f"lambda i: ('0x' || substr(hex(encode({col})), (2 * i - 1)::INT, 2))::HUGEINT)), "
        f"lambda a, b: (xor(a, b) * {fv.FNV_PRIME}::HUGEINT) % {TWO64})"
    )


def digits_of(h: str, n: int) -> str:
    step = f"(a * {fv.LCG_MULTIPLIER}::HUGEINT + {fv.LCG_INCREMENT}::HUGEINT) % {TWO64}"
    state = (
        f"list_reduce(list_prepend({h} + 1 - {h} % 2, list_transform(range(0, n), "
        f"lambda z: 0::HUGEINT)), lambda a, b: {step})"
    )
    return (
        f"array_to_string(list_transform(range(1, {n + 1}), "
        f"lambda n: (({state}) // 8589934592 % 10)::VARCHAR), '')"
    )


def pool(values, h: str) -> str:
    return f"({sql_list(values)})[({h} % {len(values)})::INT + 1]"


def context_fake(kind: str, real: str, h: str, h1: str) -> str:
    return f"""CASE {kind}
      WHEN 'person_name' THEN CASE WHEN contains({real}, ' ')
        THEN {pool(fv.FIRST_NAMES, h)} || ' ' || {pool(fv.LAST_NAMES, h1)}
        ELSE {pool(fv.FIRST_NAMES, h)} END
      WHEN 'organization' THEN {pool(fv.COMPANIES, h)}
      WHEN 'location' THEN {pool(fv.CITIES, h)}
      WHEN 'job_title' THEN {pool(fv.TITLES, h)}
      WHEN 'project_or_product' THEN {pool(fv.PROJECTS, h)}
      WHEN 'relationship' THEN {pool(fv.RELATIONSHIPS, h)}
      ELSE '[redacted-' || ({h} % {fv.REDACTED_MODULUS})::VARCHAR || ']' END"""


def hard_fake(kind: str, real: str, h: str) -> str:
    d7, d9, d15 = (digits_of(h, n) for n in (7, 9, 15))
    total = (
        f"list_sum(list_transform(range(0, 15), lambda i: CASE WHEN i % 2 = 0 THEN "
        f"CASE WHEN substr({d15}, (15 - i)::INT, 1)::INT > 4 "
        f"THEN substr({d15}, (15 - i)::INT, 1)::INT * 2 - 9 "
        f"ELSE substr({d15}, (15 - i)::INT, 1)::INT * 2 END "
        f"ELSE substr({d15}, (15 - i)::INT, 1)::INT END))"
    )
    low48 = "281474976710656"
    return f"""CASE {kind}
      WHEN 'email' THEN lower({pool(fv.FIRST_NAMES, h)}) || ({h} % 100)::VARCHAR || '@example.com'
      WHEN 'phone' THEN '(555) ' || substr({d7}, 1, 3) || '-' || substr({d7}, 4, 4)
      WHEN 'ssn' THEN substr({d9}, 1, 3) || '-' || substr({d9}, 4, 2) || '-' || substr({d9}, 6, 4)
      WHEN 'credit_card' THEN substr({d15}, 1, 4) || ' ' || substr({d15}, 5, 4) || ' '
        || substr({d15}, 9, 4) || ' ' || substr({d15}, 13, 3)
        || ((10 - {total} % 10) % 10)::INT::VARCHAR
      WHEN 'ip_address' THEN '10.' || ({h} % 256)::VARCHAR || '.' || ({h} // 256 % 256)::VARCHAR
        || '.' || ({h} // 65536 % 256)::VARCHAR
      WHEN 'ipv6' THEN 'fd00::' || printf('%x', ({h} % 65536)::BIGINT) || ':'
        || printf('%x', ({h} // 65536 % 65536)::BIGINT)
      WHEN 'api_key' THEN CASE
          WHEN starts_with(lower({real}), 'sk-ant') THEN 'sk-ant-'
          WHEN starts_with(lower({real}), 'sk-') THEN 'sk-'
          WHEN starts_with(lower({real}), 'ghp_') THEN 'ghp_'
          WHEN starts_with({real}, 'AKIA') THEN 'AKIA'
          WHEN starts_with(lower({real}), 'xox') THEN substr({real}, 1, 5) || '-'
          WHEN regexp_matches({real}, '^[a-z]{{2}}_(?:live|test)_')
            THEN regexp_extract({real}, '^[a-z]{{2}}_(?:live|test)_')
          WHEN regexp_matches({real}, '^[a-z]{{2,6}}_') THEN regexp_extract({real}, '^[a-z]{{2,6}}_')
          ELSE 'key-' END
        || printf('%012x', ({h} % {low48})::BIGINT) || '-'
        || printf('%012x', ({h} * {fv.FNV_PRIME}::HUGEINT % {low48})::BIGINT)
      WHEN 'internal_host' THEN 'host-' || printf('%08x', ({h} % 4294967296)::BIGINT)
        || coalesce(nullif(regexp_extract({real},
             '\\.(?:internal|corp|local|lan|intranet)(?:\\.[a-z]{{2,}})?$'), ''), '.internal')
      END"""


# --- detection -------------------------------------------------------------------------


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    x = f"substr({d}, length({d}) - i, 1)::INT"
    return (
        f"(length({d}) >= 13 AND list_sum(list_transform(range(0, length({d})), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN CASE WHEN {x} > 4 THEN {x} * 2 - 9 ELSE {x} * 2 END "
        f"ELSE {x} END)) % 10 = 0)"
    )


def hits(src: str, key: str, text: str = "text") -> str:
    """CTE body: key, rule, pos, kind, v - distinct hard identifiers of each text."""
    raw = " UNION ALL ".join(
        f"SELECT {key}, {i} AS rule, {q(kind)} AS kind, generate_subscripts(ms, 1) AS pos, "
        f"unnest(ms) AS m FROM (SELECT {key}, regexp_extract_all({text}, "
        f"{q('(?i)' + pattern)}) AS ms FROM {src})"
        for i, (kind, pattern) in enumerate(fv.HARD_ID_RULES)
    )
    return f"""SELECT {key}, rule, pos, kind, v,
        row_number() OVER (PARTITION BY {key} ORDER BY rule, pos) - 1 AS ord
      FROM (SELECT *, row_number() OVER (PARTITION BY {key}, v ORDER BY rule, pos) AS rn
        FROM (SELECT *, trim(m, ' ') AS v FROM ({raw})) WHERE length(v) >= 4
          AND (kind <> 'credit_card' OR {luhn('v')})
          AND (kind <> 'api_key' OR NOT regexp_full_match(v, '[0-9]+')))
      WHERE rn = 1"""


DOC_HITS = f"WITH hits AS ({hits('documents', 'doc_id')}) "

NOTES = """SELECT c_custkey, 'Ticket for user' || k || '@mail' || (k % 7) ||
    '.example.org, phone 305-555-' || lpad((k % 10000)::VARCHAR, 4, '0') ||
    ', SSN ' || lpad((k % 1000)::VARCHAR, 3, '0') || '-' || lpad((k % 100)::VARCHAR, 2, '0') ||
    '-' || lpad((k % 10000)::VARCHAR, 4, '0') || '. Card 4' || lpad(k::VARCHAR, 15, '0') ||
    ' was used from 10.' || (k % 256) || '.' || (k // 256 % 256) || '.7 and fe80:' ||
    (k % 10000) || ':1 through db' || k || '.internal.corp with sk_live_' ||
    lpad(k::VARCHAR, 12, '0') || '.' AS text
  FROM (SELECT c_custkey, c_custkey AS k FROM customer)"""
NOTE_HITS = f"WITH notes AS ({NOTES}), hits AS ({hits('notes', 'c_custkey')})"
NOTE_FAKES = (
    f"{NOTE_HITS}, fakes AS (SELECT *, {hard_fake('kind', 'v', 'h')} AS fake "
    f"FROM (SELECT *, {fnv('v')} AS h FROM hits))"
)


def rewritten(text: str, pairs: str) -> str:
    """Sequential whole-token replacement with 'find<chr 1>put' strings.

    Each pair runs twice: neighbours share the character between them.
    """
    pattern = (
        "'(^|[^A-Za-z0-9])' || regexp_escape(split_part(p, chr(1), 1)) || '($|[^A-Za-z0-9])'"
    )
    put = "'\\1' || split_part(p, chr(1), 2) || '\\2'"
    once = f"regexp_replace(t, {pattern}, {put}, 'g')"
    twice = f"regexp_replace({once}, {pattern}, {put}, 'g')"
    return f"list_reduce(list_prepend({text}, {pairs}), lambda t, p: {twice})"


PAIR_LIST = "list(v || chr(1) || fake ORDER BY length(v) DESC, v)"

# In these tables no two identifiers of a text share their first candidate, so
# the first candidate is the replacement.
DOC_SCRUBBED = f"""{DOC_HITS}, fakes AS (SELECT *, {hard_fake('kind', 'v', 'h')} AS fake
    FROM (SELECT *, {fnv('v')} AS h FROM hits)),
  maps AS (SELECT doc_id, {PAIR_LIST} AS pairs, count(*) AS n FROM fakes GROUP BY doc_id),
  done AS (SELECT d.doc_id, d.text, coalesce(n, 0) AS n_spans,
    CASE WHEN n IS NULL THEN d.text ELSE {rewritten('d.text', 'pairs')} END AS scrubbed
    FROM documents d LEFT JOIN maps USING (doc_id)) """
NOTE_SCRUBBED = f"""{NOTE_FAKES},
  maps AS (SELECT c_custkey, {PAIR_LIST} AS pairs FROM fakes GROUP BY c_custkey),
  done AS (SELECT c_custkey, {rewritten('text', 'pairs')} AS scrubbed
    FROM notes JOIN maps USING (c_custkey)) """


# --- tables ---------------------------------------------------------------------------


def header_kind(h: str) -> str:
    out = []
    for kind, how, needles in fv.HEADER_RULES:
        if how == "equals":
            out.append(f"WHEN {h} IN {in_list(needles)} THEN {q(kind)}")
        else:
            test = "suffix" if how == "ends" else "contains"
            either = " OR ".join(f"{test}({h}, {q(n)})" for n in needles)
            out.append(f"WHEN {either} THEN {q(kind)}")
    return "CASE " + " ".join(out) + " ELSE 'skip' END"


def header_of(column: str) -> str:
    return f"trim(replace(replace(lower({column}), '_', ' '), '-', ' '))"


TABLE_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "orders": [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority",
    ],
}
PII_COLUMNS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {q(t)} AS table_name, {q(c)} AS column_name, "
    f"(SELECT {header_kind('h')} FROM (SELECT {header_of(q(c))} AS h)) AS kind, "
    f"(SELECT count(DISTINCT {c}) FROM {t}) AS n_values) WHERE kind <> 'skip'"
    for t in SCANNED_TABLES for c in TABLE_COLUMNS[t]
)

CSV_TEXTS = """SELECT c_custkey // 20 AS bucket, c_custkey,
    4 + CASE WHEN (c_custkey // 20) % 3 = 0 AND c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n_fields,
    row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) AS line_no
  FROM customer"""

CSV_CELLS = f"""rows AS (SELECT bucket, line_no, t.c_custkey, c_name, c_nationkey
    FROM ({CSV_TEXTS}) t JOIN customer c ON c.c_custkey = t.c_custkey),
  cells AS (SELECT * FROM (
    SELECT bucket, line_no, 0 AS p, c_custkey::VARCHAR AS text, 'organization' AS kind FROM rows
    UNION ALL SELECT bucket, line_no, 1, c_name || ', "VIP"', 'person_name' FROM rows
    UNION ALL SELECT bucket, line_no, 2, 'city ' || c_nationkey, 'location' FROM rows)
    WHERE length(text) >= {fv.CSV_MIN_VALUE_CHARS})"""

# Each value of the first sixteen takes a name of its own; all later ones find
# every name taken and are numbered within the name of the last nudge.
NAME_MAP = f"""v AS (SELECT real, row_number() OVER (ORDER BY real) AS r
    FROM (SELECT DISTINCT c_name AS real FROM customer)),
  c AS (SELECT r, list_transform(range(0, 101), lambda k: {pool(fv.FIRST_NAMES, fnv('real', '7 * k'))})
    AS names FROM v WHERE r <= 16),
  g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS used UNION ALL
    SELECT g.r + 1, list_append(used, list_filter(names, lambda x: NOT list_contains(used, x))[1])
    FROM g JOIN c ON c.r = g.r + 1),
  late AS (SELECT real, {pool(fv.FIRST_NAMES, fnv('real', '707'))} AS base FROM v WHERE r > 16),
  mapped AS (SELECT real, (SELECT used FROM g WHERE r = (SELECT max(r) FROM g))[r] AS fake
    FROM v WHERE r <= 16 UNION ALL
    SELECT real, base || ' ' || (row_number() OVER (PARTITION BY base ORDER BY real) + 1) FROM late)"""

# --- contextual layer ---------------------------------------------------------------------

STORIES = """SELECT doc_id, text AS body, w AS words,
    coalesce(w[1], 'Nobody') AS w0, coalesce(w[2], 'Nobody') AS w1,
    coalesce(w[3], 'Nobody') AS w2, coalesce(w[4], 'Nobody') AS w3,
    'I asked my colleague ' || coalesce(w[1], 'Nobody') || ' about the '
      || coalesce(w[2], 'Nobody') || ' rollout, code-named ' || coalesce(w[3], 'Nobody')
      || ' by ' || coalesce(w[4], 'Nobody') || '. ' || text AS text
  FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]{2,}') AS w FROM documents)"""


def captures(patterns, kinds: bool = True) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rule, {q(kind)} AS kind, generate_subscripts(ms, 1) AS pos, "
        f"unnest(ms) AS t FROM (SELECT doc_id, regexp_extract_all(text, {q(pattern)}, 1) AS ms "
        f"FROM stories)"
        for i, (kind, pattern) in enumerate(patterns)
    )


CUES = f"""WITH stories AS ({STORIES}), raw AS ({captures(fv.CUE_PATTERNS)}),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY rule, pos) AS rn
    FROM (SELECT doc_id, rule, kind, pos, trim(t) AS t FROM raw)
    WHERE t <> '' AND lower(t) NOT IN {in_list(fv.SENTENCE_WORDS)})
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos) - 1 AS ord,
    t AS text, kind FROM firsts WHERE rn = 1"""

# Answer lines of every story with the kind and verdict they should be read as.
PARSED = f"""stories AS ({STORIES}),
  lines AS (SELECT doc_id, body, text AS story, 0 AS pos, w0 AS t, 'person_name' AS kind, false AS essential FROM stories
    UNION ALL SELECT doc_id, body, text, 1, w1, 'organization', true FROM stories
    UNION ALL SELECT doc_id, body, text, 2, w2, 'other_sensitive', false FROM stories
    UNION ALL SELECT doc_id, body, text, 3, w0, 'organization', true FROM stories
    UNION ALL SELECT doc_id, body, text, 4, 'not in the text at all', 'location', false FROM stories
    UNION ALL SELECT doc_id, body, text, 5, w3, 'project_or_product', true FROM stories
    UNION ALL SELECT doc_id, body, text, 6, 'my colleague ' || w0, 'relationship', true FROM stories
    UNION ALL SELECT doc_id, body, text, 7, 'what?', 'other_sensitive', false FROM stories
    UNION ALL SELECT doc_id, body, text, 8 + i, words[5 + i],
      (['person_name', 'location', 'organization'])[i % 3 + 1], i % 5 = 0
      FROM (SELECT *, unnest(range(0, len(words) - 4)) AS i FROM stories)),
  a AS (SELECT doc_id, pos, t, kind, essential FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS rn FROM lines
      WHERE contains(story, t) AND length(t) <= 64 AND NOT contains(t, '?')) WHERE rn = 1),
  b AS (SELECT doc_id, i AS pos, CASE WHEN i % 4 = 3 THEN upper(t) ELSE t END AS t,
      'person_name' AS kind, i % 2 = 0 AS essential
    FROM (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) - 1 AS i
      FROM (SELECT doc_id, list_concat(words, ['Slack', 'colleague']) AS ws FROM stories)))"""


def union_of(b: str) -> str:
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l, pos) - 1 AS ord,
      t AS text, kind, essential
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(t)) ORDER BY l, pos) AS rn
      FROM (SELECT 0 AS l, doc_id, pos, t, kind, essential FROM a UNION ALL
            SELECT 1 AS l, doc_id, pos, t, kind, essential FROM {b}))
    WHERE rn = 1"""


LABELS = [
    ("Person", "person_name"), (" full name", "person_name"), ("ORG", "organization"),
    ("school", "organization"), ("place", "location"), ("Job-Title", "job_title"),
    ("spouse", "relationship"), ("codename", "project_or_product"), ("other", "other_sensitive"),
    ("project or product", "project_or_product"),
]

AUDIT = f"""WITH stories AS ({STORIES}),
  cues AS (SELECT doc_id, count(*) AS n FROM ({CUES}) GROUP BY doc_id),
  raw AS (SELECT doc_id, story, unnest(ws) AS t, generate_subscripts(ws, 1) AS pos, first
    FROM (SELECT doc_id, text AS story, coalesce(n, 0) AS first, list_concat(words,
      ['github', '[[email]]', 'rollout', 'my colleague']) AS ws FROM stories LEFT JOIN cues USING (doc_id))),
  kept AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, strpos(story, t) AS hit FROM raw
    WHERE NOT contains(t, '[[') AND NOT contains(t, ']]')
      AND lower(t) NOT IN {in_list(fv.PUBLIC_TECH)}
      AND (regexp_matches(t, '\\p{{Lu}}') OR {' OR '.join(
          f"starts_with(lower(t), {q(p)})" for p in fv.RELATION_PREFIXES)})),
  seen AS (SELECT *, lower(substr(story, greatest(hit - {fv.AUDIT_WINDOW}, 1),
      hit + length(t) + {fv.AUDIT_WINDOW} - greatest(hit - {fv.AUDIT_WINDOW}, 1))) AS win FROM kept)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, t AS text,
    'other_sensitive' AS kind, false AS essential
  FROM seen WHERE n <= greatest({fv.AUDIT_FLOOR}, 2 * first) OR (hit > 0 AND (contains(win, '[[')
    OR {' OR '.join(f"contains(win, {q(w)})" for w in fv.AUDIT_TRIGGERS)}))"""

CHUNKS = f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
  g(doc_id, ix, i, cut) AS (
    SELECT doc_id, 0, 0::BIGINT, CASE WHEN n <= {fv.CHUNK_BUDGET} THEN n ELSE
      {{first}} END FROM d
    UNION ALL
    SELECT g.doc_id, ix + 1, nxt, {{later}} FROM (
      SELECT g.*, d.text, d.n, CASE WHEN cut - {fv.CHUNK_OVERLAP} > i
        THEN cut - {fv.CHUNK_OVERLAP} ELSE cut END AS nxt
      FROM g JOIN d USING (doc_id) WHERE cut < n) g)
  SELECT doc_id, ix AS chunk_ix, i AS start, cut - i AS n_chars,
    md5(substr(text, i + 1, cut - i)) AS digest FROM g JOIN d USING (doc_id)"""


def _cut(i: str) -> str:
    end = f"least({i} + {fv.CHUNK_BUDGET}, n)"
    low = f"greatest({i} + {fv.CHUNK_BUDGET - fv.CHUNK_LOOKBACK}, {i} + 1)"
    kept = f"length(regexp_extract(substr(text, {low} + 1, {end} - {low}), '(?s)^(.*[\n ])', 1))"
    return f"CASE WHEN {end} < n AND {kept} > 0 THEN {low} + {kept} ELSE {end} END"


CHUNKS = CHUNKS.format(first=_cut("0::BIGINT"), later=_cut("nxt"))

# --- chats ------------------------------------------------------------------------------------

MAIL = "'user' || conv_id || '@chat.example.org'"
PHONE = "'305-555-' || lpad((conv_id % 10000)::VARCHAR, 4, '0')"
CHAT_IDS = f"""WITH ids AS (SELECT conv_id, mail, phone, {hard_fake("'email'", 'mail', 'hm')} AS fm,
    {hard_fake("'phone'", 'phone', 'hp')} AS fp
  FROM (SELECT *, {fnv('mail')} AS hm, {fnv('phone')} AS hp
    FROM (SELECT DISTINCT conv_id, {MAIL} AS mail, {PHONE} AS phone FROM conversations)))
  SELECT conv_id, turn, text || ' Write to ' || fm
    || CASE WHEN turn = 0 THEN ' or ' || fp ELSE '' END || '.' AS scrubbed
  FROM conversations JOIN ids USING (conv_id)"""

# Chunks of the stories, with the answers stored for them.
STORY_CHUNKS = (CHUNKS.replace("FROM documents)", f"FROM ({STORIES}))")
                .replace("md5(substr(text, i + 1, cut - i)) AS digest", "substr(text, i + 1, cut - i) AS chunk"))
ANSWERED = f"""chunked AS ({STORY_CHUNKS}),
  answered AS (SELECT doc_id, chunk_ix, length(chunk) % 97 = 0 AS refused,
    list_concat(list_transform(regexp_extract_all(chunk, 'my colleague ([A-Z][a-z]+)', 1),
        lambda x: x || ' | person_name | no'),
      list_transform(regexp_extract_all(chunk, 'code-named ([A-Z][a-z]+)', 1),
        lambda x: x || ' | project | ' || CASE WHEN length(x) % 2 = 0 THEN 'yes' ELSE 'no' END)) AS ls
    FROM chunked)"""

TURNS = f"""turns AS (SELECT conv_id, turn, text || ' Write to ' || {MAIL} || CASE WHEN turn = 0
      THEN ' or ' || {PHONE} ELSE '' END || '.' AS text FROM conversations)"""

MESSAGE = """'{"role": ' || to_json(coalesce(role, ''))::VARCHAR || ', "content": [{"type": "text", "text": '
    || to_json(coalesce(text, '') || ' Write to ' || fm || '.')::VARCHAR
    || '}, {"type": "tool_use", "input": {"to": "' || mail || '", "n": 1.50}}, {"type": "tool_result", '
    || '"content": [{"text": "Sent to ' || fm || '", "type": "text"}, {"type": "tool_result", "content": "Again: '
    || fm || '"}]}]}'"""
REQUESTS = f"""WITH ids AS (SELECT conv_id, mail, {hard_fake("'email'", 'mail', 'hm')} AS fm
    FROM (SELECT *, {fnv('mail')} AS hm FROM (SELECT DISTINCT conv_id, {MAIL} AS mail FROM conversations)))"""

# --- scoring ------------------------------------------------------------------------------------

GONE = "list_reduce(list_prepend(text, removed), lambda t, v: replace(t, v, '[x]'))"
CASES = f"""{DOC_HITS}, base AS (SELECT doc_id AS id, d.lang AS task, d.text, d.n_chars,
      coalesce(list(v ORDER BY ord) FILTER (v IS NOT NULL), []) AS vals,
      coalesce(list(v ORDER BY ord) FILTER (kind = 'ip_address'), []) AS essential,
      coalesce(list(v ORDER BY ord) FILTER (kind IN ('email', 'phone')), []) AS few
    FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY ALL),
  outputs AS (
    SELECT *, 'all' AS strategy, vals AS removed, false AS failed FROM base UNION ALL
    SELECT *, 'some', few, false FROM base UNION ALL
    SELECT *, 'none', [], false FROM base UNION ALL
    SELECT *, 'noisy', list_concat(vals, (SELECT coalesce(list(w ORDER BY p), []) FROM (SELECT w, min(p) AS p
        FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p
          FROM (SELECT regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS ws)) GROUP BY w))),
      n_chars > 3000 FROM base),
  judged AS (SELECT strategy, id, task, failed, essential, removed, {GONE} AS scrubbed,
      list_concat(vals, vals[1:1]) AS pii,
      list_filter(list_concat(vals, vals[1:1]), lambda p: NOT list_contains(essential, p)) AS must
    FROM outputs),
  found AS (SELECT *, list_filter(must, lambda p: contains(scrubbed, p)) AS leaks,
      list_filter(essential, lambda e: NOT contains(scrubbed, e)) AS over_list,
      list_filter(removed, lambda t: NOT list_contains(pii, t)) AS extra FROM judged),
  scores AS (SELECT strategy, id, task,
      CASE WHEN failed THEN 0.0 WHEN len(must) = 0 THEN 1.0
        ELSE round_even((len(must) - len(leaks))::DOUBLE / len(must), 3) END::DOUBLE AS recall,
      CASE WHEN failed THEN ['<error>'] ELSE leaks END AS leaks,
      CASE WHEN failed THEN [] ELSE over_list END AS over_list,
      CASE WHEN failed THEN [] ELSE extra END AS extra,
      CASE WHEN failed THEN len(pii) ELSE len(must) END AS n_pii FROM found)"""
SUMMARY = """SELECT strategy, round_even(avg(recall), 3) AS mean_recall,
    sum(len(leaks))::BIGINT AS total_leaks, sum(len(over_list))::BIGINT AS total_over_scrub,
    sum(len(extra))::BIGINT AS total_extra, count(*) AS n_cases FROM scores GROUP BY strategy"""


def _doc_kind(kind: str) -> str:
    return DOC_HITS + f"SELECT doc_id, v AS value FROM hits WHERE kind = {q(kind)}"


CARD = dict(fv.HARD_ID_RULES)["credit_card"]

ORACLES: dict[str, str] = {
    "hard_id_counts": DOC_HITS + "SELECT kind, count(*) AS n_values, "
        "count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY kind",
    "hard_id_values": DOC_HITS + "SELECT doc_id, ord, v AS value, kind FROM hits",
    "email_spans": _doc_kind("email"),
    "ip_spans": _doc_kind("ip_address"),
    "phone_spans": _doc_kind("phone"),
    "api_key_spans": _doc_kind("api_key"),
    "card_luhn": f"SELECT doc_id, pos - 1 AS pos, trim(m, ' ') AS candidate, "
        f"{luhn('m')} AS luhn FROM (SELECT doc_id, generate_subscripts(ms, 1) AS pos, "
        f"unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all(text, {q(CARD)}) AS ms "
        f"FROM documents))",
    "page_hard_ids": f"SELECT page_id, ord, v AS value, kind FROM ({hits('pages', 'page_id', 'html')})",
    "note_hard_ids": NOTE_HITS + " SELECT c_custkey, ord, v AS value, kind FROM hits",
    "docs_with_pii_by_lang": DOC_HITS + "SELECT lang, kind, count(DISTINCT doc_id) AS n_docs, "
        "count(*) AS n_values FROM hits JOIN documents USING (doc_id) GROUP BY lang, kind",
    "rollup_kind_source": DOC_HITS + "SELECT kind, source, count(*) AS n FROM hits "
        "JOIN documents USING (doc_id) GROUP BY ROLLUP (kind, source)",
    "labelled_pii": DOC_HITS + "SELECT quality, toxic, count(*) AS n_docs, "
        "sum(coalesce(n, 0))::BIGINT AS n_values FROM labels LEFT JOIN "
        "(SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id) USING (doc_id) "
        "GROUP BY quality, toxic",
    "fnv_hash": f"SELECT c_custkey, format('{{:016x}}', ({fnv('c_name')})::UBIGINT) AS hash0, "
        f"format('{{:016x}}', ({fnv('c_name', '7')})::UBIGINT) AS hash7 FROM customer",
    "contextual_fakes": f"""SELECT c_custkey, real, kind,
        {context_fake('kind', 'real', 'h0', 'h1')} AS fake0,
        {context_fake('kind', 'real', 'h7', 'h8')} AS fake7
      FROM (SELECT *, unnest({sql_list(fv.CONTEXT_KINDS)}) AS kind FROM (
        SELECT *, {fnv('real')} AS h0, {fnv('real', '1')} AS h1, {fnv('real', '7')} AS h7,
          {fnv('real', '8')} AS h8
        FROM (SELECT c_custkey, unnest([c_name, c_name || ' ' || c_mktsegment]) AS real
          FROM customer)))""",
    "hard_fakes": f"""{NOTE_HITS} SELECT c_custkey, v AS value, kind,
        {hard_fake('kind', 'v', 'h0')} AS fake0, {hard_fake('kind', 'v', 'h7')} AS fake7
      FROM (SELECT *, {fnv('v')} AS h0, {fnv('v', '7')} AS h7 FROM hits)""",
    "pii_columns": PII_COLUMNS,
    "csv_field_counts": f"""SELECT bucket, line_no, n_fields FROM ({CSV_TEXTS})
      UNION ALL SELECT DISTINCT c_custkey // 20, 0, 4 FROM customer""",
    "csv_or_prose": f"""SELECT 'table' AS origin, bucket AS key,
        count(*) >= 2 AND count(*) FILTER (n_fields = 4) * 100 >= count(*) * 80 AS is_csv
      FROM ({CSV_TEXTS}) GROUP BY bucket
      UNION ALL SELECT 'document', doc_id, len(ls) >= 3 AND contains(ls[1], ',') AND n[1] >= 3
        AND len(list_filter(n[2:31], lambda x: x = n[1])) * 100 >= len(n[2:31]) * 80
      FROM (SELECT *, list_transform(ls, lambda l: len(string_split(
          regexp_replace(l, '"[^"]*(?:""[^"]*)*(?:"|$)', 'Q', 'g'), ','))) AS n
        FROM (SELECT doc_id, list_filter(string_split_regex(text,
          '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: l <> '') AS ls
          FROM documents))""",
    "csv_cells_found": f"""WITH {CSV_CELLS} SELECT bucket,
        row_number() OVER (PARTITION BY bucket ORDER BY line_no, p) - 1 AS pos, text, kind FROM cells""",
    "scrub_csv_texts": f"""WITH {CSV_CELLS}, tables AS (SELECT bucket FROM ({CSV_TEXTS}) GROUP BY bucket
        HAVING count(*) >= 2 AND count(*) FILTER (n_fields = 4) * 100 >= count(*) * 80)
      SELECT bucket, kind AS category, 'csv' AS source, count(DISTINCT text) AS n,
        count(DISTINCT text) AS n_fakes FROM cells JOIN tables USING (bucket) GROUP BY bucket, kind""",
    "scrub_customer": f"""WITH RECURSIVE {NAME_MAP}
      SELECT c_custkey, fake AS c_name, c_nationkey, c_acctbal, c_mktsegment
      FROM customer JOIN mapped ON c_name = real""",
    "scrub_contacts": f"""WITH RECURSIVE {NAME_MAP},
      hosts AS (SELECT *, 'db' || c_custkey || '.internal.corp' AS v FROM customer),
      hashed AS (SELECT *, {fnv('v')} AS h FROM hosts)
      SELECT c_custkey, fake AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN 'asked about '
        || {hard_fake("'internal_host'", 'v', 'h')} || ', segment ' || c_mktsegment END AS remark, c_acctbal
      FROM hashed JOIN mapped ON c_name = real""",
    "table_mapping": f"""WITH RECURSIVE {NAME_MAP}
      SELECT real, fake, 'person_name' AS kind FROM mapped""",
    "chunks": CHUNKS,
    "cue_candidates": CUES,
    "capped_candidates": f"""WITH w AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS pos
        FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS ws FROM documents)),
      r AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS upto FROM w),
      f AS (SELECT doc_id, min(pos) AS stop FROM r
        WHERE upto > {fv.CANDIDATE_CHARS} OR pos > {fv.CANDIDATE_ENTRIES} GROUP BY doc_id)
      SELECT d.doc_id, count(t) AS n_kept, coalesce(string_agg(t, chr(10) ORDER BY pos), '') AS block
      FROM documents d LEFT JOIN (SELECT r.* FROM r LEFT JOIN f USING (doc_id)
        WHERE stop IS NULL OR pos < stop) k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
    "parse_responses": f"""WITH {PARSED} SELECT doc_id,
        row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ord, t AS text, kind, essential
      FROM a""",
    "kind_labels": f"""SELECT doc_id, ({sql_list(l for l, _ in LABELS)})[doc_id % {len(LABELS)} + 1] AS label,
        ({sql_list(k for _, k in LABELS)})[doc_id % {len(LABELS)} + 1] AS kind FROM documents""",
    "union_spans": f"WITH {PARSED} {union_of('b')}",
    "dual_lens_merge": f"""WITH {PARSED}, c AS (SELECT doc_id, pos, t, kind, false AS essential FROM b
        WHERE regexp_matches(t, '^\\p{{Lu}}') AND lower(t) NOT IN {in_list(fv.PUBLIC_TECH)}
          AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id
            AND (contains(lower(a.t), lower(b.t)) OR contains(lower(b.t), lower(a.t)))))
      {union_of('c')}""",
    "audit_gate": AUDIT,
    "redacted_views": f"""{NOTE_HITS}, maps AS (SELECT c_custkey,
        list(v || chr(1) || '[[' || kind || ']]' ORDER BY length(v) DESC, v) AS pairs
        FROM hits GROUP BY c_custkey)
      SELECT c_custkey, {rewritten('text', 'pairs')} AS redacted FROM notes JOIN maps USING (c_custkey)""",
    "scrub_documents": DOC_SCRUBBED + "SELECT doc_id, md5(scrubbed) AS digest, n_spans FROM done",
    "scrub_notes": NOTE_SCRUBBED + "SELECT c_custkey, scrubbed FROM done",
    "scrub_span_summary": DOC_HITS + "SELECT kind AS category, 'regex' AS source, "
        "true AS scrubbed, count(*) AS n FROM hits GROUP BY kind",
    "mapping_soundness": DOC_SCRUBBED + """SELECT doc_id, side, value, count(*) AS n FROM (
        SELECT doc_id, 'real' AS side, v AS value FROM fakes UNION ALL
        SELECT doc_id, 'fake', fake FROM fakes) GROUP BY ALL HAVING count(*) > 1""",
    "restore_roundtrip": "SELECT true AS restored, count(*) AS n_docs FROM documents",
    "restore_by_join": DOC_SCRUBBED + "SELECT doc_id, md5(CASE WHEN doc_id % 10 <> 0 "
        "THEN text ELSE scrubbed END) AS digest FROM done",
    "payload_restore": NOTES,
    "stream_restore": NOTES,
    "restore_event_stream": f"""SELECT *, 'other,other,stop,end' AS passed,
        (c_custkey % 3 = 0)::BIGINT AS n_late, 0::BIGINT AS n_lost FROM ({NOTES})""",
    "scrub_chat_ids": CHAT_IDS,
    "scrub_chat_ids_by_join": CHAT_IDS,
    "finder_answers": f"""WITH {ANSWERED} SELECT doc_id, chunk_ix,
        CASE WHEN NOT refused THEN array_to_string(ls, chr(10)) END AS answer,
        CASE WHEN refused THEN 'refused' END AS warning FROM answered""",
    "stored_answer_spans": f"""WITH {ANSWERED}, lines AS (
        SELECT doc_id, chunk_ix, generate_subscripts(ls, 1) AS pos, string_split(unnest(ls), ' | ') AS p
        FROM answered WHERE NOT refused),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_ix, p[1] ORDER BY pos) AS rn FROM lines)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_ix, pos) - 1 AS ord, p[1] AS text,
        CASE p[2] WHEN 'project' THEN 'project_or_product' ELSE p[2] END AS kind, p[3] = 'yes' AS essential
      FROM firsts WHERE rn = 1
      UNION ALL SELECT doc_id, -1, string_agg('a section was checked for fixed patterns only: refused', '; '),
        'warning', false FROM answered WHERE refused GROUP BY doc_id""",
    "scrub_chats_model": f"""WITH {TURNS}, words AS (
        SELECT conv_id, turn, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w, n
        FROM (SELECT *, length(text) AS n, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS ws FROM turns)
        WHERE n % 7 <> 0),
      verdicts AS (SELECT conv_id, w, arg_min((length(w) + n) % 2 = 0, (turn, pos)) AS essential
        FROM words GROUP BY ALL)
      SELECT conv_id, w AS text, 'person_name' AS category, 'model' AS source, essential,
        NOT essential AS scrubbed, essential AS same FROM verdicts
      UNION ALL SELECT DISTINCT conv_id, {MAIL}, 'email', 'regex', false, true, false FROM conversations
      UNION ALL SELECT DISTINCT conv_id, {PHONE}, 'phone', 'regex', false, true, false FROM conversations WHERE turn = 0""",
    "scrub_chats_model_warnings": f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0
        THEN 'a section was checked for fixed patterns only: refused' ELSE '' END AS warnings FROM turns""",
    "scrub_request_bodies": f"""{REQUESTS} SELECT conv_id AS request_id,
        CASE WHEN conv_id % 50 <> 0 THEN md5('{{"model":"m-1", "temperature": 0.70, "system": "Account ' || any_value(fm)
          || '", "messages": [' || string_agg({MESSAGE}, ', ' ORDER BY turn) || '], "max_tokens": 1e3}}') END AS digest,
        CASE WHEN conv_id % 50 = 0 THEN 'body is not a JSON object' END AS error
      FROM conversations JOIN ids USING (conv_id) GROUP BY conv_id""",
    "restore_reply_bodies": f"""{REQUESTS} SELECT conv_id AS request_id, '{{"id":"r' || conv_id
        || '", "content": [{{"type": "text", "text": "Sent to ' || v || ', ' || v || '"}}, {{"type": "tool_use", "input": {{"to": "'
        || fm || '"}}}}, {{"type": "text", "text": "no one else"}}], "usage": {{"n": 1.50}}}}' AS restored
      FROM (SELECT *, CASE WHEN conv_id % 10 = 0 THEN fm ELSE mail END AS v FROM ids) WHERE conv_id % 50 <> 0""",
    "dataset_mapping": DOC_HITS + """SELECT kind, count(*) AS n_values, count(*) AS n_fakes
      FROM (SELECT v, arg_min(kind, (rule, doc_id, pos)) AS kind FROM hits GROUP BY v) GROUP BY kind""",
    "adjacent_ids_roundtrip": """WITH ssn AS (SELECT c_custkey, list_transform(
          [c_custkey, c_custkey * 13 + 5], lambda k: (100 + k % 500) || '-' || (10 + k % 80) || '-'
            || (1000 + (k * 7) % 9000)) AS s FROM customer)
      SELECT scope_kind, c_custkey, 'ids ' || s[1] || ' ' || s[2] || ' end' AS restored
      FROM ssn, (VALUES ('text'), ('chat'), ('dataset')) v(scope_kind)""",
    "scrub_dataset_mixed": f"""WITH tables AS (SELECT bucket FROM ({CSV_TEXTS}) GROUP BY bucket
        HAVING count(*) >= 2 AND count(*) FILTER (n_fields = 4) * 100 >= count(*) * 80),
      known AS (SELECT DISTINCT c_nationkey AS n FROM customer JOIN tables ON bucket = c_custkey // 20)
      SELECT -1 - (c_custkey // 20) AS doc_id, bool_or(n IS NULL) AS cells_left
      FROM customer LEFT JOIN known ON n = c_nationkey GROUP BY 1
      UNION ALL SELECT doc_id, contains(text, ',city ') FROM documents""",
    "adopted_mapping": f"""{NOTE_HITS} SELECT scope, kind, count(*) AS n_values, count(*) AS n_fakes,
        (count(*) FILTER (first % 2 = 0))::BIGINT AS n_kept
      FROM (SELECT (c_custkey % 50)::VARCHAR AS scope, v, min(c_custkey) AS first,
          arg_min(kind, c_custkey) AS kind FROM hits GROUP BY 1, 2) GROUP BY 1, 2""",
    "chat_turns": "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations "
        "WHERE regexp_matches(text, '\\S')",
    "chat_requests": """SELECT conv_id * 1000 + turn AS request_id, 0 AS ord, 'system' AS path,
        role AS text FROM conversations
      UNION ALL SELECT conv_id * 1000 + turn, 1, 'messages[0].content[0].text', text
        FROM conversations WHERE regexp_matches(text, '\\S')""",
    "run_table_merge": NOTE_SCRUBBED + """SELECT c_custkey AS path, 'document' AS part, 0 AS para,
        run, CASE WHEN run = 0 THEN scrubbed ELSE '' END AS text
      FROM (SELECT c_custkey, scrubbed, unnest(range(0, ceil(length(text) / 25)::BIGINT)) AS run
        FROM done JOIN notes USING (c_custkey))""",
    "mapping_files": """SELECT (1700000000 + doc_id) || '-' || source || '_' || lang
          || '_v1.map.json' AS file_name,
        source || '_' || lang || '_v1' AS source_name, 1700000000 + doc_id AS epoch
      FROM documents WHERE doc_id % 5 <> 0 ORDER BY doc_id DESC LIMIT 40""",
    "mapping_names": """SELECT doc_id, (1700000000 + doc_id) || '-' || source
          || '___report_final.map.json' AS file_name,
        '/in/' || source || '/doc.v' || doc_id || '.scrubbed.'
          || CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'md' END AS out_path FROM documents""",
    "stored_mappings": NOTE_FAKES + " SELECT c_custkey, fake, v AS real FROM fakes",
    "score_cases": CASES + """ SELECT strategy, id, task, recall, len(leaks) AS n_leaks,
        len(over_list) AS n_over, len(extra) AS n_extra, n_pii FROM scores""",
    "score_strategies": CASES + SUMMARY,
    "rank_strategies": CASES + f""" SELECT row_number() OVER (ORDER BY total_leaks, mean_recall DESC,
        total_over_scrub, total_extra, strategy) AS rank, strategy FROM ({SUMMARY})""",
    "case_report": CASES + """ SELECT strategy, id, task, recall, len(leaks) AS n_leaks,
        len(over_list) AS n_over, concat_ws('; ',
          CASE WHEN len(leaks) > 0 THEN 'LEAK:' || substr(array_to_string(leaks, ','), 1, 36) END,
          CASE WHEN len(over_list) > 0 THEN 'over:' || substr(array_to_string(over_list, ','), 1, 20)
          END) AS notes FROM scores""",
    "stored_scopes": NOTE_FAKES + " SELECT c_custkey, fake, v AS real FROM fakes",
    "cached_scores": DOC_HITS + """SELECT d.doc_id, coalesce(n, 0)::INT AS n_values,
        CASE WHEN d.text IN (SELECT text FROM documents WHERE lang = 'en') THEN 1 ELSE 2 END AS run
      FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1) USING (doc_id)""",
    "incremental_scores": """SELECT doc_id, cache_key FROM (SELECT doc_id,
        substr(sha256('v1' || chr(0) || 'regex' || chr(0) || text), 1, 16) AS cache_key FROM documents)
      WHERE cache_key NOT IN (SELECT substr(sha256('v1' || chr(0) || 'regex' || chr(0) || text), 1, 16)
        FROM documents WHERE doc_id % 3 = 0)""",
}
