"""SQL for the rows of op8_quotation_links: windows as strings, holders by joins, trees by recursion."""

from __future__ import annotations

from .chat import _NO_BLANKS, MIN_CHARS, REPLY_EVERY, REPLY_TURN, SHARE, WORDS

_LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
_ATTRIBUTION = r"(?i)[ \t]*(?:on .+ wrote|am .+ schrieb .+|le .+ a écrit|el .+ escribió)[ \t]*:[ \t]*"
_WORDS = rf"regexp_extract_all(regexp_replace(lower({{}}), '([{_NO_BLANKS}])', ' \1 ', 'g'), '[{_NO_BLANKS}]|[\p{{{{L}}}}\p{{{{N}}}}]+')"
#: Own conversation first, then (conv_id, turn), the null conv_id last.
_ORDER = "{a}.conv_id IS DISTINCT FROM to_conv, to_conv IS NULL, to_conv, to_turn"


def _windows(source: str, keep: str) -> str:
    """Distinct windows (keep..., key) of the words w in source."""
    keys = f"list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + {WORDS - 1}), ' '))"
    return f"SELECT DISTINCT {keep}, unnest({keys}) AS key FROM {source} WHERE len(w) > 0"


LINKS_SQL = f"""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM {{messages}}),
raw AS (SELECT rid, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM m),
marked AS (SELECT rid, pos, line, regexp_extract(line, '^[ \t>]*') AS marks FROM raw),
levelled AS (SELECT rid, pos, length(marks) - length(replace(marks, '>', '')) AS level, CASE WHEN contains(marks, '>') THEN substr(line, length(marks) + 1) ELSE line END AS body FROM marked),
ahead AS (SELECT *, coalesce(lead(CASE WHEN trim(body, ' ' || chr(9) || chr(11) || chr(12)) <> '' THEN level END IGNORE NULLS) OVER (PARTITION BY rid ORDER BY pos), 0) AS deeper FROM levelled),
kept AS (SELECT * FROM ahead WHERE NOT (deeper > level AND regexp_full_match(body, '{_ATTRIBUTION}'))),
steps AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY pos) THEN 1 ELSE 0 END AS new FROM kept),
lines AS MATERIALIZED (SELECT rid, pos, level, body, sum(new) OVER (PARTITION BY rid ORDER BY pos) AS seg, {_WORDS.format('body')} AS w FROM steps),
segs AS MATERIALIZED (SELECT rid, seg, any_value(level) AS level, flatten(list(w ORDER BY pos)) AS w FROM lines GROUP BY rid, seg),
short AS (SELECT rid, w FROM (SELECT rid, w FROM lines WHERE level = 0 UNION ALL
  SELECT rid, {_WORDS.format('s')} FROM (SELECT rid, unnest(regexp_split_to_array(body, '[.!?;:…]+\\s+|[。！？]')) AS s FROM lines WHERE level = 0)) WHERE len(w) < {WORDS}),
passages AS (SELECT DISTINCT conv_id, turn, text, seg, level, w, len(w) < {WORDS} AND length(array_to_string(w, ' ')) < {MIN_CHARS} AS near FROM segs JOIN m USING (rid) WHERE level > 0 AND len(w) > 0),
q AS MATERIALIZED ({_windows('passages', 'conv_id, turn, text, seg, level, near')}),
sizes AS (SELECT conv_id, turn, text, seg, count(*) AS size FROM q GROUP BY ALL),
own AS (SELECT DISTINCT conv_id, turn, key FROM ({_windows('(SELECT rid, w FROM segs WHERE level = 0 UNION ALL SELECT rid, w FROM short)', 'rid')}) JOIN m USING (rid) WHERE turn IS NOT NULL AND key IN (SELECT key FROM q)),
idx AS MATERIALIZED (SELECT o.conv_id, o.key, min(o.turn) AS near_turn, min(o.turn) FILTER (WHERE x.key IS NULL) AS source_turn
  FROM own o LEFT JOIN (SELECT DISTINCT conv_id, turn, key FROM q) x ON x.key = o.key AND x.turn = o.turn AND x.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY o.conv_id, o.key),
tops AS (SELECT key, conv_id, coalesce(source_turn, near_turn) AS turn, row_number() OVER (PARTITION BY key ORDER BY source_turn IS NULL, conv_id NULLS LAST) AS k FROM idx),
found AS (SELECT q.*, CASE WHEN n.near_turn < q.turn THEN 0 WHEN q.near THEN NULL WHEN a.key IS NOT NULL AND a.conv_id IS DISTINCT FROM q.conv_id THEN 1 WHEN b.key IS NOT NULL AND b.conv_id IS DISTINCT FROM q.conv_id THEN 2 END AS which,
    n.near_turn, a.conv_id AS a_conv, a.turn AS a_turn, b.conv_id AS b_conv, b.turn AS b_turn
  FROM q LEFT JOIN idx n ON n.key = q.key AND n.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN tops a ON a.key = q.key AND a.k = 1 LEFT JOIN tops b ON b.key = q.key AND b.k = 2),
votes AS (SELECT conv_id, turn, text, seg, level, CASE which WHEN 0 THEN conv_id WHEN 1 THEN a_conv ELSE b_conv END AS to_conv, CASE which WHEN 0 THEN near_turn WHEN 1 THEN a_turn ELSE b_turn END AS to_turn, count(*) AS n
  FROM found WHERE which IS NOT NULL GROUP BY ALL),
best AS (SELECT v.*, size FROM votes v JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM v.conv_id AND s.turn IS NOT DISTINCT FROM v.turn AND s.text = v.text AND s.seg = v.seg
  QUALIFY row_number() OVER (PARTITION BY v.conv_id, v.turn, v.text, v.seg ORDER BY n DESC, {_ORDER.format(a='v')}) = 1),
linked AS MATERIALIZED (SELECT * FROM best WHERE n * {SHARE} >= size),
stats AS (SELECT s.conv_id, s.turn, s.text, count(*) AS n_quoted, count(l.seg) AS n_linked FROM sizes s
  LEFT JOIN linked l ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.turn IS NOT DISTINCT FROM s.turn AND l.text = s.text AND l.seg = s.seg GROUP BY s.conv_id, s.turn, s.text),
own_sums AS (SELECT conv_id, turn, text, level, to_conv, to_turn, sum(n) AS n FROM linked WHERE turn IS NOT NULL GROUP BY ALL),
own_up AS MATERIALIZED (SELECT conv_id, turn, text, to_conv, to_turn FROM own_sums QUALIFY row_number() OVER (PARTITION BY conv_id, turn, text ORDER BY level, n DESC, {_ORDER.format(a='own_sums')}) = 1),
sums AS (SELECT conv_id, turn, level, to_conv, to_turn, sum(n) AS n FROM linked WHERE turn IS NOT NULL GROUP BY ALL),
up AS MATERIALIZED (SELECT conv_id, turn, to_conv, to_turn FROM sums QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, {_ORDER.format(a='sums')}) = 1),
walk AS (SELECT conv_id AS c, turn AS t, to_conv AS at_c, to_turn AS at_t, [{{'no': conv_id IS NULL, 'c': conv_id, 't': turn}}] AS path FROM up
  UNION ALL SELECT w.c, w.t, u.to_conv, u.to_turn, list_append(path, {{'no': w.at_c IS NULL, 'c': w.at_c, 't': w.at_t}}) FROM walk w JOIN up u ON u.conv_id IS NOT DISTINCT FROM w.at_c AND u.turn = w.at_t
  WHERE NOT list_contains(path, {{'no': w.at_c IS NULL, 'c': w.at_c, 't': w.at_t}})),
cut AS (SELECT DISTINCT list_sort(path)[1] AS least FROM walk WHERE at_c IS NOT DISTINCT FROM c AND at_t = t),
tree AS MATERIALIZED (SELECT up.* FROM up WHERE NOT EXISTS (SELECT 1 FROM cut WHERE least.c IS NOT DISTINCT FROM up.conv_id AND least.t = up.turn)),
climb AS (SELECT conv_id AS c, turn AS t, to_conv AS at_c, to_turn AS at_t, 1 AS depth FROM tree
  UNION ALL SELECT k.c, k.t, u.to_conv, u.to_turn, depth + 1 FROM climb k JOIN tree u ON u.conv_id IS NOT DISTINCT FROM k.at_c AND u.turn = k.at_t),
roots AS (SELECT c, t, arg_max({{'c': at_c, 't': at_t}}, depth) AS root, max(depth) AS depth FROM climb GROUP BY c, t),
bare AS (SELECT rid, trim(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0), ''), chr(10)) AS bare FROM lines GROUP BY rid),
mine AS (SELECT o.*, coalesce(r.root.c, CASE WHEN r.t IS NULL THEN o.to_conv END) AS root_conv, coalesce(r.root.t, o.to_turn) AS root_turn, coalesce(r.depth, 0) + 1 AS depth
  FROM own_up o JOIN tree t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.turn = o.turn LEFT JOIN roots r ON r.c IS NOT DISTINCT FROM o.to_conv AND r.t = o.to_turn),
placed AS (SELECT m.conv_id, m.turn, m.role, CASE WHEN contains(m.text, '>') THEN coalesce(bare, '') ELSE m.text END AS text, o.to_conv AS parent_conv, o.to_turn AS parent_turn,
    CASE WHEN o.to_turn IS NOT NULL THEN o.root_conv ELSE m.conv_id END AS root_conv, CASE WHEN o.to_turn IS NOT NULL THEN o.root_turn ELSE m.turn END AS root_turn, coalesce(o.depth, 0) AS depth,
    coalesce(s.n_quoted, 0) AS n_quoted, coalesce(s.n_linked, 0) AS n_linked
  FROM m LEFT JOIN bare USING (rid) LEFT JOIN mine o ON o.conv_id IS NOT DISTINCT FROM m.conv_id AND o.turn = m.turn AND o.text = m.text
  LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.turn IS NOT DISTINCT FROM m.turn AND s.text = m.text)
SELECT conv_id, turn, role, parent_conv, parent_turn, root_conv, root_turn, depth, n_quoted, n_linked, text,
       row_number() OVER (PARTITION BY root_conv ORDER BY root_turn NULLS FIRST, depth, conv_id NULLS LAST, turn NULLS FIRST, role NULLS FIRST, text) - 1 AS position
FROM placed
"""

#: As with_replies makes them.
_REPLIES = f"""(SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT conv_id, turn + {REPLY_TURN}, 'reply', 'On Monday, A. wrote:' || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || 'Thank you, noted.'
  FROM conversations WHERE conv_id % {REPLY_EVERY} = 0 AND length(trim(text)) BETWEEN 1 AND {1 << 20})"""
OP8_SQL = LINKS_SQL.replace("{messages}", "conversations")
REPLIES_SQL = LINKS_SQL.replace("{messages}", _REPLIES)
