"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

SQL = {
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents
        ), totals AS (
            SELECT source, count(*) AS total FROM documents GROUP BY source
        ), counted AS (
            SELECT source, line, count(*) AS n FROM lines
            WHERE regexp_matches(line, '[^ \t\n\x0b\x0c\r]') GROUP BY source, line HAVING count(*) >= 2
        ), boilerplate AS (
            SELECT c.source, list(line) AS marks
            FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
            WHERE n > 0.1::DOUBLE * total GROUP BY c.source
        ), split AS (
            SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines,
                   coalesce(b.marks, []) AS marks
            FROM documents d LEFT JOIN boilerplate b ON d.source IS NOT DISTINCT FROM b.source
        ), kept AS (
            SELECT *, list_filter(lines, lambda x: NOT list_contains(marks, x)) AS left_over FROM split
        )
        SELECT doc_id, source,
               CASE WHEN lines IS NULL THEN NULL ELSE coalesce(array_to_string(left_over, chr(10)), '') END AS text,
               CAST(coalesce(len(lines) - len(left_over), 0) AS BIGINT) AS n_dropped
        FROM kept
    """,
    "op11_benchmark_decontamination": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
            FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(words[s : s + n - 1], ' ') AS win
            FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS s
                  FROM (SELECT *, least(len(words), 10) AS n FROM items WHERE len(words) > 0))
        ), places AS (
            SELECT doc_id, n, s, array_to_string(words[s : s + n - 1], ' ') AS win
            FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s
                  FROM texts, (SELECT DISTINCT n FROM windows))
        ), hits AS (
            SELECT DISTINCT doc_id, p.n, s, item_id FROM places p JOIN windows w ON p.n = w.n AND p.win = w.win
        ), covered AS (
            SELECT doc_id, count(DISTINCT word) AS n_hit
            FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS word FROM hits) GROUP BY doc_id
        ), listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id LEFT JOIN listed l ON t.doc_id = l.doc_id
    """,
}
