"""DuckDB twins of the operators that SQL can express."""

#: CRC-32 of a short text: the table of its steps, then one step a byte.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM range(256) AS r(i))
)"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, beside ``crc_table``."""
    step = f"t[(xor(c, ascii(substr({text}, k::INT + 1, 1))) & 255) + 1]"
    return f"xor(list_reduce(range(length({text})), lambda c, k: xor(c >> 8, {step}), 4294967295), 4294967295)"


OP13 = f"""
WITH RECURSIVE
d AS (
  SELECT doc_id, lang,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
           CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
           CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
           CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' END) AS head,
    coalesce(text, '') AS text,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
),
{CRC_TABLE},
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, sha256(head || text) AS node,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0
      THEN sha256(head || low) ELSE sha256(head || text) END AS found
  FROM d CROSS JOIN crc_table
),
tree AS (
  SELECT lang, 0 AS lvl, idx, node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 8
),
subroots AS (SELECT lang, lvl AS height, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, idx // 8
),
nodes AS (
  SELECT lang, lvl, idx, node FROM tree WHERE n > 1
  UNION ALL
  SELECT s.lang, s.height + t.lvl, t.idx, t.node FROM subroots s CROSS JOIN top t WHERE t.n > 1
),
runs AS (SELECT lang, lvl, idx // 8 AS run, list(node ORDER BY idx) AS members FROM nodes GROUP BY ALL),
walk AS (
  SELECT l.doc_id, l.lang, l.node AS leaf, s.node AS subroot, s.height, s.idx AS place, 0 AS lvl, l.idx, l.found AS folded, '' AS siblings
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.subroot, w.height, w.place, w.lvl + 1, w.i // 8,
    sha256(array_to_string(w.members[: w.i % 8], '') || w.folded || array_to_string(w.members[w.i % 8 + 2 :], '')),
    w.siblings || array_to_string(w.members[: w.i % 8], '') || array_to_string(w.members[w.i % 8 + 2 :], '')
  FROM (SELECT walk.*, r.members, CASE WHEN walk.lvl = walk.height THEN walk.place ELSE walk.idx END AS i
        FROM walk JOIN runs r ON walk.lang IS NOT DISTINCT FROM r.lang AND walk.lvl = r.lvl
          AND r.run = CASE WHEN walk.lvl = walk.height THEN walk.place ELSE walk.idx END // 8) w
)
SELECT w.doc_id, w.leaf, w.subroot, r.node AS root, sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = r.node AS verified
FROM walk w CROSS JOIN (SELECT node, lvl FROM top WHERE n = 1) r WHERE w.lvl = w.height + r.lvl
"""

#: States are the role that came last (0 none, 1 system, 2 user, 3 assistant);
#: a path is its cost in ten digits, its audit, a blank and its lines.
OP11 = rf"""
WITH RECURSIVE
{CRC_TABLE},
placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
),
acts AS (SELECT placed.*, {crc32("place")} % 20 AS act FROM placed CROSS JOIN crc_table),
damaged AS (
  SELECT conv_id, turn, CASE act WHEN 4 THEN 'user' ELSE role END AS role,
    CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM acts CROSS JOIN range(2) AS r(copy) WHERE act <> 0 AND (copy = 0 OR act = 3)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
    CASE role[1] WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS kind
  FROM damaged
),
faults AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(kind) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND (before, kind) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
),
inserts(q, r, cost, audit, added) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
),
steps(r, s, edit) AS (
  SELECT q, q, 'D' FROM range(4) AS t(q)
  UNION ALL VALUES (0, 1, 'K'), (0, 2, 'K'), (1, 2, 'K'), (2, 3, 'K'), (3, 2, 'K'), (0, 2, 'R'), (1, 2, 'R'), (2, 3, 'R'), (3, 2, 'R')
),
edits AS (
  SELECT conv_id, i, s.r, s.s, n.cost + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost,
    n.q, n.audit || edit AS audit,
    n.added || CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE s.s WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END AS added
  FROM faults f JOIN steps s ON edit = 'D' OR (fault IS NULL OR fault = 'truncated') AND (edit = 'R' OR s.s = kind) JOIN inserts n ON n.r = s.r
),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, p.i + 1, e.s, min({{'cost': best.cost + e.cost, 'audit': best.audit || e.audit, 'lines': best.lines || e.added}})
  FROM paths p JOIN edits e ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = p.i + 1 AND e.q = p.q GROUP BY ALL
),
ended AS (
  SELECT p.conv_id, min({{'cost': best.cost + n.cost, 'audit': best.audit || n.audit, 'lines': best.lines || n.added}}) AS best
  FROM paths p LEFT JOIN counts c ON p.conv_id IS NOT DISTINCT FROM c.conv_id JOIN inserts n ON n.q = p.q AND n.r IN (0, 3)
  WHERE p.i = coalesce(c.n, 0) GROUP BY p.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
