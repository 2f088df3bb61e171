"""The SQL twin of quotation linking: passages are compared as texts, branches are walked by recursion."""

from __future__ import annotations

_NORMAL = r"trim(regexp_replace(lower({0}), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def _normal(text: str) -> str:
    return _NORMAL.format(text)


OP2_SQL = rf"""
WITH RECURSIVE messages AS (
    SELECT row_number() OVER () AS m, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, 'user') AS role,
           string_split(coalesce(text, ''), chr(10)) AS lines
    FROM conversations
), numbered AS (
    SELECT m, conv_id, turn, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM messages
), marked AS (
    SELECT m, conv_id, turn, i, line, regexp_extract(line, '^(?:[ \t]*>)+') AS mark FROM numbered
), levelled AS (
    SELECT m, conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) AS level,
           CASE WHEN mark = '' THEN line ELSE regexp_replace(substr(line, length(mark) + 1), '^[ \t]', '') END AS rest
    FROM marked
), islands AS (
    SELECT *, i - row_number() OVER (PARTITION BY m, level ORDER BY i) AS island FROM levelled
), runs AS (
    SELECT m, conv_id, turn, level, min(i) AS start, string_agg(rest, chr(10) ORDER BY i) AS body
    FROM islands GROUP BY m, conv_id, turn, level, island
), bodies AS (
    SELECT m, trim(string_agg(body, chr(10) ORDER BY start), ' ' || chr(9) || chr(13) || chr(10)) AS body
    FROM runs WHERE level = 0 GROUP BY m
), quotes AS (
    SELECT m, conv_id, turn, level, body, row_number() OVER (PARTITION BY m ORDER BY start) AS q
    FROM runs WHERE level > 0 AND {_normal("body")} <> ''
), passages AS (
    SELECT s.conv_id, s.turn, unnest(list_concat([b.body], regexp_split_to_array(b.body, '\n[ \t]*\n'))) AS p
    FROM messages s JOIN bodies b USING (m) WHERE s.conv_id IS NOT NULL AND s.turn IS NOT NULL
), units AS (
    SELECT conv_id, turn, {_normal("p")} AS u FROM passages
    UNION ALL
    SELECT conv_id, turn, {_normal("l")} FROM (SELECT conv_id, turn, unnest(string_split(p, chr(10))) AS l FROM passages)
), originals AS (
    SELECT conv_id, u, min(turn) AS origin FROM units WHERE u <> '' GROUP BY conv_id, u
), asked AS (
    SELECT conv_id, turn, q, level, true AS whole, {_normal("body")} AS u FROM quotes
    UNION ALL
    SELECT conv_id, turn, q, level, false, {_normal("l")}
    FROM (SELECT conv_id, turn, q, level, unnest(string_split(body, chr(10))) AS l FROM quotes)
    WHERE len(string_split({_normal("l")}, ' ')) >= 3
), linked AS (
    SELECT a.conv_id, a.turn, a.q, a.level, max(row(a.whole, o.origin)) AS best
    FROM asked a JOIN originals o USING (conv_id, u) WHERE o.origin < a.turn GROUP BY ALL
), answered AS (
    SELECT conv_id, turn, max(row(-level, best[2]))[2] AS answers, count(DISTINCT q) AS n_linked
    FROM linked GROUP BY conv_id, turn
), turns AS (
    SELECT t.*, a.answers, coalesce(a.n_linked, 0) AS n_linked, lag(t.turn) OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS previous
    FROM (SELECT DISTINCT conv_id, turn FROM messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL) t
    LEFT JOIN answered a USING (conv_id, turn)
), parents AS (
    SELECT *, coalesce(answers, previous) AS parent_turn FROM turns
), placed AS (
    SELECT *, max(CASE WHEN previous IS NULL OR parent_turn <> previous THEN turn END)
                  OVER (PARTITION BY conv_id ORDER BY turn) AS run
    FROM parents
), heads AS (
    SELECT h.conv_id, h.run, h.parent_turn, u.run AS up
    FROM placed h LEFT JOIN placed u ON u.conv_id = h.conv_id AND u.turn = h.parent_turn WHERE h.turn = h.run
), branches AS (
    SELECT conv_id, run, '' AS path FROM heads WHERE up IS NULL
    UNION ALL
    SELECT h.conv_id, h.run, b.path || CASE WHEN b.path = '' THEN '' ELSE '/' END || h.parent_turn || '-' || h.run
    FROM heads h JOIN branches b ON b.conv_id = h.conv_id AND b.run = h.up
)
SELECT s.conv_id, s.turn, s.role, p.parent_turn, count(q.q) AS n_quotes, coalesce(p.n_linked, 0) AS n_linked,
       coalesce(r.path, '') AS branches, '<|' || s.role || '|>' || chr(10) || coalesce(b.body, '') || chr(10) AS formatted
FROM messages s
LEFT JOIN bodies b USING (m)
LEFT JOIN quotes q USING (m)
LEFT JOIN placed p ON p.conv_id = s.conv_id AND p.turn = s.turn
LEFT JOIN branches r ON r.conv_id = p.conv_id AND r.run = p.run
GROUP BY s.m, s.conv_id, s.turn, s.role, p.parent_turn, p.n_linked, r.path, b.body
"""
