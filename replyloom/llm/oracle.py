"""The same results as plain SQL for another engine, where SQL can express them."""

from __future__ import annotations

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri),
hit AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1),
cnt AS (SELECT doc_id, count(*) AS n_repeat_words FROM hit GROUP BY doc_id),
f AS (
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
    FROM w LEFT JOIN cnt ON w.doc_id = cnt.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
        OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 5 * n_symbols > n_words
        OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > n_letters) AS kept
FROM f
"""

_MIXING = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
    FROM documents
),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [1, 2, 3][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w
    FROM d GROUP BY source
),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS t, CAST(sum(w) AS BIGINT) AS w FROM s),
fill AS (
    SELECT 0 AS step, t AS rest, w AS weight FROM total
    UNION ALL
    SELECT step + 1, CAST(n.rest AS BIGINT), CAST(n.weight AS BIGINT) FROM (
        SELECT step, (SELECT t FROM total) - coalesce(sum(3 * source_size) FILTER (3 * source_size < CAST(rest AS DOUBLE) * s.w / CAST(weight AS DOUBLE)), 0) AS rest,
            coalesce(sum(s.w) FILTER (NOT 3 * source_size < CAST(rest AS DOUBLE) * s.w / CAST(weight AS DOUBLE)), 0) AS weight,
            any_value(weight) AS had
        FROM fill, s GROUP BY step
    ) AS n WHERE n.weight NOT IN (0, n.had)
),
fin AS (SELECT rest, weight FROM fill ORDER BY step DESC LIMIT 1),
tgt AS (
    SELECT source, source_size,
        CASE WHEN 3 * source_size < CAST(rest AS DOUBLE) * w / CAST(weight AS DOUBLE) THEN CAST(3 * source_size AS DOUBLE)
            ELSE CAST(rest AS DOUBLE) * w / CAST(weight AS DOUBLE) END AS target
    FROM s, fin
),
cells AS (
    SELECT d.*, coalesce('s' || source, 'null') AS k, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0')
        || rpad(substr(bin(size), 1, 3), 3, '0')
        || lpad(CAST(CAST('0x' || substr(ord, 1, 5) AS BIGINT) % 1024 AS VARCHAR), 4, '0') AS cell
    FROM d
),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cell, ord) - 1 AS p FROM cells),
drawn AS (
    SELECT doc_id, size, source_size, target, p,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e,
        (CAST('0x' || substr(md5('20:' || k), 1, 5) AS BIGINT) + 0.5) / 1048576.0 AS o
    FROM placed JOIN tgt ON placed.source IS NOT DISTINCT FROM tgt.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, CAST(least(floor(o + (p + 1) * e) - floor(o + p * e), 3) AS BIGINT) AS copies FROM drawn)
"""

_CONTAMINATION = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w
    FROM documents
),
bw AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), '[^ ]+') AS w
    FROM benchmark
),
win AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bw WHERE len(w) > 0)
),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
grams AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)
),
occ AS (SELECT doc_id, i, grams.n, item FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id
),
it AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM occ WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""

_NEGATIVES = r"""
WITH r AS (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
n AS (SELECT row_number() OVER () AS uid, * FROM r),
s AS (
    SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid AS uid, b.vec_id AS vec_id, a.label = b.label AS same,
        CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM n AS a JOIN n AS b ON a.vec_id % 50 = 0 AND a.uid <> b.uid
),
p AS (
    SELECT anchor, anchor_id, uid, vec_id AS positive_id, score AS positive_score
    FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY s.score DESC, s.vec_id NULLS LAST) <= 3
"""

ORACLE: dict[str, str] = {
    "op4_contamination": _CONTAMINATION,
    "op6_quality_rules": _QUALITY,
    "op7_mixing": _MIXING,
    "op12_hard_negatives": _NEGATIVES,
}
