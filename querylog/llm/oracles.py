"""SQL for the queries on training text that SQL can express (DuckDB's dialect)."""

from __future__ import annotations

from querylog.llm.shared import LOWER, UPPER

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_PLAIN = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+')"

CHATS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), seen AS (
    SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) != role, true) AS opens,
        length(text) + len(regexp_extract_all(text,
            '[<\[]\\*(?:/?s>|</?SYS>>|/?INST\]|ANSWER\]|/?ROLE\]|TURN\])')) AS chars,
        CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 12 ELSE 17 + length(role) END AS marks
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(chars + CASE WHEN opens THEN marks ELSE 6 END) AS BIGINT) AS formatted_chars
FROM seen GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_PLAIN} AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item, s, array_to_string(w[i:i + s - 1], ' ') AS words
    FROM (
        SELECT item, w, least(10, len(w)) AS s, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0
    )
), dw AS (
    SELECT doc_id, i, s, array_to_string(w[i:i + s - 1], ' ') AS words
    FROM (
        SELECT doc_id, w, s, unnest(generate_series(1, len(w) - s + 1)) AS i
        FROM d, (SELECT DISTINCT s FROM iw) WHERE len(w) >= s
    )
),
hit AS (SELECT DISTINCT doc_id, i, s, words FROM dw SEMI JOIN iw USING (words)),
cov AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + s - 1)) AS p FROM hit) GROUP BY doc_id
),
who AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
    FROM hit JOIN iw USING (words) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN who USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) > 1
        THEN [w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)] ELSE w END) AS shingles FROM d
),
sets AS (SELECT list_sort(shingles) AS shingles, len(shingles) AS n, min(doc_id) AS id FROM s WHERE len(shingles) > 0 GROUP BY ALL),
e AS (SELECT id, n, unnest(shingles) AS shingle FROM sets),
few AS (SELECT shingle, count(*) AS df FROM e GROUP BY shingle),
-- of two sets that are linked, the rarest fifth of either's shingles (and one) must share one
ordered AS (SELECT id, n, shingle, row_number() OVER (PARTITION BY id ORDER BY df, shingle) AS r FROM e JOIN few USING (shingle)),
prefix AS (SELECT id, n, shingle FROM ordered WHERE r <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
pairs AS (
    SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b USING (shingle)
    WHERE a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
),
counts AS (
    SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.shingles, y.shingles)) AS shared
    FROM pairs JOIN sets x ON x.id = a JOIN sets y ON y.id = b
),
links AS (SELECT a, b FROM counts WHERE 100 * shared >= 80 * (na + nb - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id, id AS r FROM sets UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r),
component AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
named AS (SELECT shingles, component_id FROM sets JOIN component USING (id))
SELECT doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
    doc_id = coalesce(component_id, doc_id) AS kept
FROM s LEFT JOIN named ON named.shingles = list_sort(s.shingles)
"""

_PAGE = "CASE WHEN url IS NULL OR NOT contains(url, '://') THEN '' ELSE {} END"


def url_filter(rules) -> str:
    rows = ", ".join(f"('{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}', '{verdict}')" for rule, verdict in rules)
    host = _PAGE.format(f"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')")
    path = _PAGE.format("regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)")
    return f"""
WITH rules(h, p, rule, verdict) AS (VALUES {rows}),
parts AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
judged AS (
    SELECT page_id, host, path, (
        SELECT max_by(r, length(r.rule)) FROM rules r
        WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)
    ) AS r FROM parts
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM judged
"""

_LOWER_TEXT = f"translate(text, '{UPPER}', '{LOWER}')"


def _leaf(text: str) -> str:
    parts = (f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
    return f"sha256({' || '.join(parts)})"


# CRC-32 by a table, eight bits at a time; trees of eight children, level by level.
MERKLE = f"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) t(i)
), rows AS (
    SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf(_LOWER_TEXT)} AS lowered,
        xor(CAST(4294967295 AS UBIGINT), list_reduce(
            [CAST(4294967295 AS UBIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS UBIGINT)),
            lambda c, b: xor(c >> 8, steps[1 + CAST(xor(c, b) & 255 AS BIGINT)]))) % 3 = 0 AS hit
    FROM documents, crc
), leaves AS (
    SELECT doc_id, lang IS NULL AS no_lang, coalesce(lang, '') AS tree, leaf, CASE WHEN hit THEN lowered ELSE leaf END AS now,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total
    FROM rows
), up AS (
    SELECT no_lang, tree, 0 AS level, pos, leaf AS h, total FROM leaves
    UNION ALL
    SELECT no_lang, tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (total + 7) // 8
    FROM up WHERE total > 1 GROUP BY no_lang, tree, level, pos // 8, total
), tops AS (
    SELECT no_lang, tree, h, row_number() OVER (ORDER BY NOT no_lang, tree) - 1 AS place, count(*) OVER () AS total
    FROM up WHERE total = 1
), over AS (
    SELECT 0 AS level, place AS pos, h, total FROM tops
    UNION ALL
    SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (total + 7) // 8 FROM over WHERE total > 1 GROUP BY level, pos // 8, total
), low AS (
    SELECT no_lang, tree, level, pos, coalesce(string_agg(h, '') OVER (PARTITION BY no_lang, tree, level, pos // 8 ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') OVER (PARTITION BY no_lang, tree, level, pos // 8 ORDER BY pos
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM up WHERE total > 1
), high AS (
    SELECT level, pos, coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM over WHERE total > 1
), steps AS (
    SELECT x.no_lang, x.tree, x.pos, s.level, s.l, s.r
    FROM leaves x JOIN low s ON s.no_lang = x.no_lang AND s.tree = x.tree AND s.pos = x.pos // CAST(pow(8, s.level) AS BIGINT)
    UNION ALL
    SELECT x.no_lang, x.tree, x.pos, 1000 + s.level, s.l, s.r
    FROM leaves x JOIN tops t USING (no_lang, tree) JOIN high s ON s.pos = t.place // CAST(pow(8, s.level) AS BIGINT)
), paths AS (
    SELECT no_lang, tree, pos, list({{'l': l, 'r': r}} ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS proof
    FROM steps GROUP BY no_lang, tree, pos
)
SELECT doc_id, leaf, t.h AS subroot, o.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([{{'l': now, 'r': ''}}] || coalesce(path, []), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root,
    folded_root = root AS verified
FROM leaves x JOIN tops t USING (no_lang, tree) JOIN (SELECT h FROM over WHERE total = 1) o ON true
LEFT JOIN paths p ON p.no_lang = x.no_lang AND p.tree = x.tree AND p.pos = x.pos
"""
