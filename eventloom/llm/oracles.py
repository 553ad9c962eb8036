"""SQL that whole queries must equal."""

from __future__ import annotations

from . import lines

#: Line dedup by the same filters in SQL.
LINES = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS v FROM documents),
x AS (SELECT doc_id, unnest(v) AS line, unnest(range(0, len(v))) AS line_no FROM d),
s AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[ \t\x0B\x0C\r]+'), lambda w: w <> ''))) AS s FROM x),
l AS (SELECT *, len(s) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS p FROM s WHERE len(s) >= 1),
e AS (SELECT s, any_value(n) AS n, min(p) AS p FROM l GROUP BY s),
t AS (SELECT p, n, unnest(s) AS w FROM e), f AS (SELECT w, count(*) AS c FROM t GROUP BY w),
r AS (SELECT p, n, w, row_number() OVER (PARTITION BY p ORDER BY c, w) AS k FROM t JOIN f USING (w)),
q AS (SELECT p, n, w FROM r WHERE k <= n - (85 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.p AS pa, b.p AS pb FROM q a JOIN q b ON a.w = b.w AND a.p < b.p AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT pb AS p FROM c JOIN e a ON a.p = pa JOIN e b ON b.p = pb WHERE 100 * len(list_intersect(a.s, b.s)) >= 85 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
g AS (SELECT doc_id, line_no FROM l JOIN e USING (s) WHERE l.p <> e.p UNION SELECT doc_id, line_no FROM l JOIN m USING (p)),
o AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed FROM g GROUP BY 1)
SELECT doc_id, CAST(len(v) AS BIGINT) AS n_lines, coalesce(o.n, 0) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN o USING (doc_id)"""
assert (lines.PERCENT, lines.LEAST) == (85, 1)

#: Chats: the turns as they are, and the sizes of headings and escapes.
CHATS = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
k AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')) + 7 AS body, CASE WHEN k = 1 OR role <> last THEN length(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:')) + 6 + (k > 1)::INT ELSE 0 END AS head FROM k),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(body + head) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
