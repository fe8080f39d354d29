"""The queries of this subpackage in SQL, where SQL can express them, by query name."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_decontaminate"] = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
iwords AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM iwords WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, g.size, i, item_id FROM grams g JOIN windows USING (win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (
    SELECT DISTINCT doc_id, item_id::varchar AS name FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
    sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op2_exact_dedup"] = """
WITH rows AS (SELECT doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM rows JOIN groups USING (t)
"""

# The template is that of chat.py: OPEN role SAYS text (NEXT text)* CLOSE per block of one role; escaped by one sign.
ORACLES["op9_chat"] = r"""
WITH turns AS (
    SELECT conv_id, turn::bigint AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    length(text) + length(regexp_replace(text, '[^\x{241B}]', '', 'g')) + len(regexp_extract_all(text, '<s>|</s>|<\||\[INST\]|\[/INST\]')) AS size,
    length(role) + length(regexp_replace(role, '[^\x{241B}]', '', 'g')) + len(regexp_extract_all(role, '<s>|</s>|<\||\[INST\]|\[/INST\]')) AS head
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(size + CASE WHEN last = role THEN 8 ELSE 3 + head + 8 + 4 END)::bigint AS formatted_chars
FROM placed GROUP BY conv_id
"""

ORACLES["op6_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, i - 1 AS line_no, list_filter(string_split(translate(l[i],
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '') AS w
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
firsts AS (SELECT w, min((doc_id, line_no)) AS first FROM lines WHERE len(w) > 0 GROUP BY w),
tokens AS (SELECT DISTINCT first, unnest(w) AS token FROM firsts),
sized AS (SELECT *, count(*) OVER (PARTITION BY first) AS n FROM tokens),
pairs AS (SELECT x.first AS first, y.first AS earlier FROM sized x JOIN sized y ON x.token = y.token AND y.first < x.first
    GROUP BY x.first, y.first, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
gone AS (
    SELECT doc_id, line_no FROM lines JOIN firsts USING (w)
    WHERE (doc_id, line_no) <> first OR first IN (SELECT first FROM pairs)),
removed AS (SELECT doc_id, count(*) AS n, string_agg(line_no::varchar, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END::bigint AS n_lines,
    coalesce(n, 0)::bigint AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN removed USING (doc_id)
"""
