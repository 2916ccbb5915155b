"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations


_OP3 = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
),
numbered AS (
    SELECT doc_id, body, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS place
    FROM texts WINDOW same AS (PARTITION BY body)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM numbered
"""


def _crc_table() -> str:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return str(out)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH RECURSIVE runs AS (
    SELECT key, run, count(*) AS n FROM (
        SELECT coalesce(doc_id::VARCHAR, '') AS key,
            unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run
        FROM documents
    ) WHERE length(run) >= 6 GROUP BY ALL
),
raw AS (SELECT run, n, hex(encode(key || ':' || run)) AS x FROM runs),
hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1]))) AS h
    FROM raw
),
noised AS (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
    FROM hashed
),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM noised WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
shorter AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_over
    FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)
),
pairs AS (
    SELECT a.word, b.word AS near FROM shorter a JOIN shorter b USING (i, left_over)
    WHERE a.word <> b.word AND length(a.word) = length(b.word)
    UNION SELECT a.word, b.word FROM shorter a JOIN words b ON a.left_over = b.word
    UNION SELECT b.word, a.word FROM shorter a JOIN words b ON a.left_over = b.word
),
ranked AS (
    SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
        row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
    FROM pairs p JOIN words w ON w.word = p.near
),
forms AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
        CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
),
chains AS (
    SELECT word, word AS root FROM forms
    UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c USING (word) JOIN forms e ON e.word = c.root AND e.form IS NULL
"""

_OP12 = r"""
WITH RECURSIVE orders AS (
    SELECT '' AS filter_order
    UNION ALL SELECT filter_order || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(f) WHERE NOT contains(filter_order, f)
),
steps AS (
    SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS filter, substr(filter_order, 1, step::INT - 1) AS earlier
    FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5
),
texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
    FROM texts LEFT JOIN known USING (doc_id)
),
sums AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
counts AS (
    SELECT part, filter_order, step, filter,
        coalesce(sum(n) FILTER (WHERE NOT contains(fails, filter) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || 'z]'))), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || 'z]'))), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE contains(fails, filter) AND earlier <> '' AND regexp_matches(fails, '[' || earlier || 'z]')), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE fails = filter), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE contains(fails, filter) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || 'z]'))), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE contains(fails, filter) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || 'z]'))), 0) AS toxic_lost
    FROM sums, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
    good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counts
"""

_WORDS_13 = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP13 = rf"""
WITH items AS (SELECT item_id, {_WORDS_13} AS words FROM benchmark),
item_windows AS (
    SELECT DISTINCT item_id, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS body FROM (
        SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i
        FROM items WHERE len(words) > 0
    )
),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS_13} AS words FROM documents),
doc_windows AS (
    SELECT row, i, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS body FROM (
        SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM docs, (SELECT DISTINCT size FROM item_windows) WHERE len(words) >= size
    )
),
hits AS (SELECT row, i, size, item_id FROM doc_windows JOIN item_windows USING (size, body)),
hit_words AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS word FROM hits) GROUP BY row),
hit_items AS (SELECT row, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": _OP3,
        "op11_spelling_variants": _OP11,
        "op12_filter_audit": _OP12,
        "op13_benchmark_decontamination": _OP13,
    }
