"""DuckDB counterparts of the registered queries."""

from __future__ import annotations

from .fixture_sql import with_views

STATS_6 = """ROUND(u.user_mean_rating, 6) AS user_mean_rating, u.user_ratings_count,
       ROUND(b.book_mean_rating, 6) AS book_mean_rating, b.book_ratings_count,
       ROUND(a.author_mean_rating, 6) AS author_mean_rating"""

AGGREGATE_FEATURES = f"""
        SELECT r.user_id, r.book_id, {STATS_6}
        FROM merged r LEFT JOIN user_stats u ON r.user_id = u.user_id LEFT JOIN book_stats b ON r.book_id = b.book_id
        LEFT JOIN (SELECT author_id, AVG(rating) AS author_mean_rating FROM merged
                   WHERE source = 'train' GROUP BY author_id) a ON r.author_id = a.author_id
        WHERE r.source = 'test'"""

PREPARED_6 = """user_id, book_id, has_read, ROUND(rating, 6) AS rating, "timestamp", source, gender, ROUND(age, 6) AS age,
       title, author_id, author_name, ROUND(publication_year, 6) AS publication_year, language, publisher,
       ROUND(avg_rating, 6) AS avg_rating, book_genres_count"""


def _split_date(table: str, column: str, ratio: str, extra: str = "") -> str:
    return f"""
    SELECT {extra} {column} AS split_date
    FROM (SELECT {column}, ROW_NUMBER() OVER (ORDER BY {column}) - 1 AS place, COUNT(*) OVER () AS n FROM {table})
    WHERE place = CAST(FLOOR(n * CAST({ratio} AS DOUBLE)) AS BIGINT)"""


RATED_CUT = """(SELECT "timestamp" FROM (SELECT "timestamp", ROW_NUMBER() OVER (ORDER BY "timestamp") - 1 AS place,
        COUNT(*) OVER () AS n FROM rated) WHERE place = CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT))"""


PARITY_MEANS = f"""SELECT user_id % 2 AS u, book_id % 2 AS b, AVG(rating) AS m FROM rated
        WHERE "timestamp" <= {RATED_CUT} GROUP BY ALL"""


def _filled_stats(rows: str, train: str, part: str | None, columns: str) -> str:
    mean = f"(SELECT AVG(rating) FROM {train})"
    label = f"'{part}' AS part," if part else ""
    return f"""
    SELECT {columns} {label}
           ROUND(COALESCE(u.m, {mean}), 6) AS user_mean_rating, COALESCE(u.n, 0) AS user_ratings_count,
           ROUND(COALESCE(b.m, {mean}), 6) AS book_mean_rating, COALESCE(b.n, 0) AS book_ratings_count,
           ROUND(COALESCE(a.m, {mean}), 6) AS author_mean_rating
    FROM {rows} r
    LEFT JOIN (SELECT user_id, AVG(rating) AS m, COUNT(rating) AS n FROM {train} GROUP BY user_id) u
           ON r.user_id = u.user_id
    LEFT JOIN (SELECT book_id, AVG(rating) AS m, COUNT(rating) AS n FROM {train} GROUP BY book_id) b
           ON r.book_id = b.book_id
    LEFT JOIN (SELECT author_id, AVG(rating) AS m FROM {train} GROUP BY author_id) a ON r.author_id = a.author_id"""


def _scores(submission: str, solution: str) -> str:
    return f"""
    SELECT g.stage, COUNT(e) AS n, ROUND(COALESCE(SQRT(AVG(e * e)), 0), 6) AS rmse,
           ROUND(COALESCE(AVG(ABS(e)), 0), 6) AS mae,
           ROUND(COALESCE(1 - (0.5 * SQRT(AVG(e * e)) / 10 + 0.5 * AVG(ABS(e)) / 10), 0), 6) AS score
    FROM (SELECT 'public' AS stage UNION ALL SELECT 'private') g
    LEFT JOIN (SELECT t.stage, GREATEST(0, LEAST(10, s.rating_predict)) - t.rating AS e
               FROM {submission} s JOIN {solution} t ON s.user_id = t.user_id AND s.book_id = t.book_id) x
           ON g.stage = x.stage
    GROUP BY g.stage"""


def _report(totals: str, label: str, lines: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT CAST({no} AS INT) AS check_no, '{name}' AS "check", ({bad}) = 0 AS passed,
            CAST({bad} AS BIGINT) AS bad_rows, '{label}' AS input FROM ({totals})"""
        for no, (name, bad) in enumerate(lines, start=1)
    )


def _submission_report(table: str, label: str) -> str:
    value = "CAST(rating_predict AS VARCHAR)"
    totals = f"""
    SELECT (SELECT COUNT(*) FROM {table}) AS given, (SELECT COUNT(*) FROM solution) AS expected,
           (SELECT COUNT(*) FROM {table} WHERE rating_predict IS NOT NULL
               AND TRY_CAST({value} AS DOUBLE) IS NULL) AS malformed,
           (SELECT COUNT(*) FROM {table} WHERE rating_predict IS NULL) AS absent,
           (SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY user_id, book_id)) AS repeated,
           (SELECT COUNT(*) FROM (SELECT user_id, book_id FROM solution EXCEPT SELECT user_id, book_id FROM {table}))
               AS missing,
           (SELECT COUNT(*) FROM (SELECT user_id, book_id FROM {table} EXCEPT SELECT user_id, book_id FROM solution))
               AS extra"""
    return _report(
        totals,
        label,
        [
            ("not_empty", "CASE WHEN given = 0 THEN 1 ELSE 0 END"),
            ("columns", "0"),
            ("numeric", "malformed"),
            ("no_nulls", "absent"),
            ("no_duplicates", "repeated"),
            ("row_count", "ABS(given - expected)"),
            ("no_missing_pairs", "missing"),
            ("no_extra_pairs", "extra"),
        ],
    )


def _solution_report(table: str, label: str) -> str:
    number = "TRY_CAST(CAST(rating AS VARCHAR) AS DOUBLE)"
    totals = f"""
    SELECT COUNT(*) AS n,
           COUNT(*) FILTER (rating IS NOT NULL AND {number} IS NULL) AS malformed,
           COUNT(*) FILTER (rating IS NULL) AS absent,
           COUNT(*) FILTER ({number} < 0 OR {number} > 10) AS outside,
           COUNT(*) FILTER (stage IS NULL) AS no_stage,
           COUNT(*) FILTER (stage NOT IN ('public', 'private')) AS other_stage,
           COUNT(*) FILTER (stage = 'public') AS public, COUNT(*) FILTER (stage = 'private') AS private,
           (SELECT COALESCE(SUM(k - 1), 0) FROM (SELECT COUNT(*) AS k FROM {table} GROUP BY user_id, book_id)) AS repeated
    FROM {table}"""
    return _report(
        totals,
        label,
        [
            ("not_empty", "CASE WHEN n = 0 THEN 1 ELSE 0 END"),
            ("columns", "0"),
            ("no_duplicates", "repeated"),
            ("numeric", "malformed"),
            ("no_nulls", "absent"),
            ("in_range", "outside"),
            ("stage_not_null", "no_stage"),
            ("stage_known", "other_stage"),
            ("has_public", "CASE WHEN public = 0 THEN 1 ELSE 0 END"),
            ("has_private", "CASE WHEN private = 0 THEN 1 ELSE 0 END"),
        ],
    )


def _upload_report(table: str, label: str) -> str:
    number = "TRY_CAST(CAST(rating_predict AS VARCHAR) AS DOUBLE)"
    totals = f"""
    SELECT (SELECT COUNT(*) FROM {table}) AS given, (SELECT COUNT(*) FROM solution) AS expected,
           (SELECT COUNT(*) FROM {table} WHERE {number} IS NULL) AS absent,
           (SELECT COUNT(*) FROM {table} WHERE NOT COALESCE({number} BETWEEN 0 AND 10, FALSE)) AS outside,
           (SELECT COALESCE(SUM(ABS(COALESCE(s.n, 0) - COALESCE(t.n, 0))), 0)
            FROM (SELECT user_id, book_id, COUNT(*) AS n FROM {table} GROUP BY ALL) s
            FULL JOIN (SELECT user_id, book_id, COUNT(*) AS n FROM solution GROUP BY ALL) t
              ON s.user_id = t.user_id AND s.book_id = t.book_id) AS unequal"""
    return _report(
        totals,
        label,
        [
            ("length", "ABS(given - expected)"),
            ("no_nulls", "absent"),
            ("keys", "unequal"),
            ("in_range", "outside"),
        ],
    )


POOLED = """
    SELECT vec_id, (place - 1) % 8 AS dim,
           ROUND(SUM(value * mask) / GREATEST(SUM(mask), 1e-9), 6) AS pooled
    FROM (SELECT vec_id, place, CAST(embedding[place] AS DOUBLE) AS value,
                 CASE WHEN vec_id % 11 <> 0 AND (vec_id + (place - 1) // 8) % 3 <> 0 THEN 1 ELSE 0 END AS mask
          FROM embeddings, range(1, 65) AS p(place))
    GROUP BY vec_id, (place - 1) % 8"""

_ROWS = """(SELECT user_id, book_id, source, "timestamp" FROM both_sources)"""
_INDEX = """(SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS i
             FROM (SELECT DISTINCT COALESCE({0}, '-1') AS v FROM merged))"""

_SQL: dict[str, str] = {
    "chunk_counts": """
        SELECT chunk, COUNT(*) AS n, MIN("timestamp") AS first_time, MAX("timestamp") AS last_time
        FROM interaction_log GROUP BY chunk""",
    "clean_anomalies": """
        SELECT user_id, book_id, has_read, rating, "timestamp"
        FROM (SELECT user_id, book_id, has_read, "timestamp",
                     CASE WHEN has_read = 1 OR l_linenumber = 7 THEN rating ELSE CAST(0 AS DOUBLE) END AS rating
              FROM unfiltered_log)
        WHERE NOT (has_read = 0 AND rating > 0)""",
    "last_read_per_user": """
        SELECT user_id, book_id, rating, "timestamp"
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
                                           ORDER BY "timestamp" DESC, book_id DESC, rating DESC) AS rn
              FROM interaction_log WHERE chunk = 2 AND has_read = 1) WHERE rn = 1""",
    "warm_users": "SELECT user_id FROM warm",
    "keep_warm_users": """
        SELECT user_id, book_id, rating, "timestamp"
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
                                           ORDER BY "timestamp" DESC, book_id DESC, rating DESC) AS rn
              FROM interaction_log WHERE chunk = 2 AND has_read = 1)
        WHERE rn = 1 AND user_id IN (
            SELECT user_id FROM train_raw GROUP BY user_id
            HAVING COUNT(*) FILTER (has_read = 1) >= 30 OR COUNT(*) FILTER (has_read = 0) >= 20)""",
    "test_formation": "SELECT user_id, book_id, rating, stage FROM solution",
    "book_avg_rating": """
        SELECT book_id, ROUND(AVG(rating), 6) AS avg_rating FROM interaction_log WHERE has_read = 1 GROUP BY book_id""",
    "book_avg_rating_all": """
        SELECT book_id, ROUND(AVG(rating), 6) AS avg_rating FROM interaction_log GROUP BY book_id""",
    "genre_books_count": """
        SELECT genre_id, COUNT(DISTINCT book_id) AS books_count FROM book_genres GROUP BY genre_id""",
    "rated_interactions": """SELECT user_id, book_id, has_read, rating, "timestamp" FROM rated""",
    "dedupe_books": """
        SELECT book_id, title, author_id, author_name, publication_year, language, publisher, avg_rating, row_order
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY book_id ORDER BY row_order) AS rn FROM books) WHERE rn = 1""",
    "merged_interactions": """
        SELECT user_id, book_id, has_read, rating, "timestamp", source, gender, age, title, author_id, author_name,
               publication_year, language, publisher, avg_rating FROM merged""",
    "user_agg": """
        SELECT user_id, ROUND(user_mean_rating, 6) AS user_mean_rating, user_ratings_count FROM user_stats""",
    "book_agg": """
        SELECT book_id, ROUND(book_mean_rating, 6) AS book_mean_rating, book_ratings_count FROM book_stats""",
    "author_agg": """
        SELECT author_id, ROUND(AVG(rating), 6) AS author_mean_rating FROM merged
        WHERE source = 'train' AND author_id IS NOT NULL GROUP BY author_id""",
    "genre_count": "SELECT book_id, book_genres_count FROM genre_counts",
    "attach_genre_count": f"""
        SELECT r.*, g.book_genres_count FROM {_ROWS} r LEFT JOIN genre_counts g ON r.book_id = g.book_id""",
    "aggregate_features": AGGREGATE_FEATURES,
    "aggregate_features_split": AGGREGATE_FEATURES,
    "age_median": "SELECT MEDIAN(age) AS age_median FROM merged",
    "global_mean_rating": "SELECT ROUND(AVG(rating), 6) AS global_mean FROM rated",
    "fill_missing": f"SELECT {PREPARED_6} FROM prepared",
    "fill_after_aggregates": _filled_stats(
        "(SELECT * FROM prepared WHERE source = 'test')", "prepared_train", None,
        "r.user_id, r.book_id, r.author_id, r.age,",
    ),
    "split_date": _split_date("lineitem", "l_shipdate", "0.8"),
    "split_date_events": _split_date("events", "ts", "0.5", "CAST(0.5 AS DOUBLE) AS ratio,")
    + " UNION ALL "
    + _split_date("events", "ts", "0.8", "CAST(0.8 AS DOUBLE) AS ratio,"),
    "temporal_split": f"""
        SELECT user_id, book_id, rating, "timestamp",
               CASE WHEN "timestamp" <= {RATED_CUT} THEN 'train' ELSE 'validation' END AS part FROM rated""",
    "split_bounds": f"""
        SELECT COUNT(*) FILTER ("timestamp" <= {RATED_CUT}) AS n_train,
               COUNT(*) FILTER ("timestamp" > {RATED_CUT}) AS n_val,
               MAX("timestamp") FILTER ("timestamp" <= {RATED_CUT}) AS max_train,
               MIN("timestamp") FILTER ("timestamp" > {RATED_CUT}) AS min_val FROM rated""",
    "leakfree_aggregates": _filled_stats(
        "early", "early", "train", 'r.user_id, r.book_id, r."timestamp", ROUND(r.rating, 6) AS rating,'
    )
    + " UNION ALL "
    + _filled_stats(
        "late", "early", "validation", 'r.user_id, r.book_id, r."timestamp", ROUND(r.rating, 6) AS rating,'
    ),
    "tokenize": """
        SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents)""",
    "ngrams": """
        SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, '|')) AS terms_md5
        FROM (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t
              FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents))""",
    "train_descriptions": """
        SELECT book_id, description, row_order FROM descriptions WHERE book_id IN (SELECT book_id FROM rated)""",
    "description_lookup": f"""
        SELECT r.*, LENGTH(COALESCE(t.description, '')) AS n_chars, md5(COALESCE(t.description, '')) AS description_md5
        FROM {_ROWS} r LEFT JOIN last_texts t ON r.book_id = t.book_id""",
    "tfidf_vocab": "SELECT term, idx, tf, df, ROUND(idf, 6) AS idf FROM vocabulary",
    "tfidf_weights": """
        SELECT book_id, idx, ROUND(x / SQRT(SUM(x * x) OVER (PARTITION BY book_id)), 6) AS weight FROM raw_weights""",
    "book_vectors": """
        SELECT book_id, 'tfidf' AS kind, idx, ROUND(w, 6) AS value
        FROM (SELECT book_id, idx, x / SQRT(SUM(x * x) OVER (PARTITION BY book_id)) AS w FROM raw_weights)
        WHERE ROUND(w, 6) <> 0 AND book_id IN (SELECT book_id FROM merged)
        UNION ALL
        SELECT a.book_id, 'embedding' AS kind, CAST(d.i AS BIGINT) AS idx,
               ROUND(COALESCE(CAST(v.embedding[d.i + 1] AS DOUBLE), 0), 6) AS value
        FROM (SELECT DISTINCT book_id FROM merged) a CROSS JOIN range(0, 64) AS d(i)
             LEFT JOIN vectors v ON a.book_id = v.book_id""",
    "gbt_group_means": f"""
        SELECT s.user_id, s.book_id, ROUND(m.m, 6) AS rating_predict
        FROM solution s JOIN ({PARITY_MEANS}) m ON s.user_id % 2 = m.u AND s.book_id % 2 = m.b""",
    "gbt_group_loss": f"""
        SELECT CAST(1 AS BIGINT) AS best_round, ROUND(AVG(e * e), 6) AS loss, COUNT(*) AS n,
               ROUND(SQRT(AVG(e * e)), 6) AS rmse, ROUND(AVG(ABS(e)), 6) AS mae
        FROM (SELECT m.m - r.rating AS e FROM rated r JOIN ({PARITY_MEANS}) m
                     ON r.user_id % 2 = m.u AND r.book_id % 2 = m.b
              WHERE r."timestamp" > {RATED_CUT})""",
    "gbt_stump_rounds": f"""
        SELECT * FROM (WITH RECURSIVE parts AS (
            SELECT "timestamp" > {RATED_CUT} AS late, user_id % 2 AS u, book_id % 2 AS b,
                   rating + 2 * (user_id % 2) + book_id % 2 AS y
            FROM rated WHERE "timestamp" IS NOT NULL
        ), sums AS (
            SELECT late,
                   COUNT(*) FILTER (u = 0 AND b = 0) AS n00, COALESCE(SUM(y) FILTER (u = 0 AND b = 0), 0) AS s00,
                   COUNT(*) FILTER (u = 0 AND b = 1) AS n01, COALESCE(SUM(y) FILTER (u = 0 AND b = 1), 0) AS s01,
                   COUNT(*) FILTER (u = 1 AND b = 0) AS n10, COALESCE(SUM(y) FILTER (u = 1 AND b = 0), 0) AS s10,
                   COUNT(*) FILTER (u = 1 AND b = 1) AS n11, COALESCE(SUM(y) FILTER (u = 1 AND b = 1), 0) AS s11,
                   COUNT(*) AS n, SUM(y * y) AS q
            FROM parts GROUP BY late
        ), rounds AS (
            SELECT CAST(0 AS BIGINT) AS round, CAST(0 AS DOUBLE) AS f00, CAST(0 AS DOUBLE) AS f01,
                   CAST(0 AS DOUBLE) AS f10, CAST(0 AS DOUBLE) AS f11
            UNION ALL
            SELECT round + 1, f00 + step * CASE WHEN by_user THEN u0 ELSE b0 END,
                   f01 + step * CASE WHEN by_user THEN u0 ELSE b1 END,
                   f10 + step * CASE WHEN by_user THEN u1 ELSE b0 END,
                   f11 + step * CASE WHEN by_user THEN u1 ELSE b1 END
            FROM (
                SELECT *, u0 * u0 * (n00 + n01) + u1 * u1 * (n10 + n11)
                          > b0 * b0 * (n00 + n10) + b1 * b1 * (n01 + n11) AS by_user
                FROM (
                    -- The first tree counts fully; later ones fit twice the remainder and count by the step size.
                    SELECT round, f00, f01, f10, f11, n00, n01, n10, n11,
                           CASE WHEN round = 0 THEN 1 ELSE 2 * 0.2::DOUBLE END AS step,
                           (s00 - n00 * f00 + s01 - n01 * f01) / (n00 + n01) AS u0,
                           (s10 - n10 * f10 + s11 - n11 * f11) / (n10 + n11) AS u1,
                           (s00 - n00 * f00 + s10 - n10 * f10) / (n00 + n10) AS b0,
                           (s01 - n01 * f01 + s11 - n11 * f11) / (n01 + n11) AS b1
                    FROM rounds, sums WHERE NOT late AND round < 16))
        ), losses AS (
            SELECT round, (q - 2 * (f00 * s00 + f01 * s01 + f10 * s10 + f11 * s11)
                           + n00 * f00 * f00 + n01 * f01 * f01 + n10 * f10 * f10 + n11 * f11 * f11) / n AS loss
            FROM rounds, sums WHERE late AND round > 0
        ), leaders AS (
            SELECT round, loss, ARG_MIN(round, loss) OVER (ORDER BY round) AS leader FROM losses
        ), settled AS (
            SELECT COALESCE(MIN(round) FILTER (round - leader >= 3), 16) AS last FROM leaders
        )
        SELECT round, ROUND(loss, 6) AS loss, round = (SELECT leader FROM leaders, settled WHERE round = last) AS kept
        FROM leaders WHERE round <= (SELECT last FROM settled))""",
    "embedding_texts": "SELECT book_id, description FROM first_texts",
    "embedding_cache_missing": """
        SELECT book_id FROM first_texts WHERE book_id NOT IN (SELECT book_id FROM vectors)""",
    "embed_missing_books": """
        SELECT book_id, CAST(dim AS BIGINT) AS dim,
               ROUND(CAST(CAST(COALESCE(AVG(CAST('0x' || SUBSTRING(md5(w), CAST(2 * dim + 1 AS INT), 2) AS INT)), 0)
                               AS FLOAT) AS DOUBLE), 2) AS value
        FROM (SELECT book_id, UNNEST(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w
              FROM (SELECT book_id, regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}') AS ws FROM first_texts
                    WHERE book_id NOT IN (SELECT book_id FROM vectors))),
             range(0, 2) AS d(dim)
        GROUP BY book_id, dim""",
    "embedding_lookup": f"""
        SELECT r.*, CAST(64 AS BIGINT) AS dim, ROUND(COALESCE(CAST(v.embedding[1] AS DOUBLE), 0), 6) AS first_value,
               ROUND(COALESCE(CAST(v.embedding[64] AS DOUBLE), 0), 6) AS last_value,
               ROUND(COALESCE(list_sum(list_transform(v.embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE))), 0), 6)
                   AS squared_length
        FROM {_ROWS} r LEFT JOIN vectors v ON r.book_id = v.book_id""",
    "masked_mean_pool": POOLED,
    "masked_mean_pool_long": POOLED,
    "feature_matrix": """
        SELECT user_id, book_id, gender, age, author_id, publication_year, language, publisher,
               ROUND(avg_rating, 6) AS avg_rating, book_genres_count FROM prepared""",
    "categorical_index": f"""
        SELECT r.user_id, r.book_id, r.source, r."timestamp", g.i AS gender_index, l.i AS language_index,
               p.i AS publisher_index
        FROM merged r JOIN {_INDEX.format("gender")} g ON COALESCE(r.gender, '-1') = g.v
        JOIN {_INDEX.format("language")} l ON COALESCE(r.language, '-1') = l.v
        JOIN {_INDEX.format("publisher")} p ON COALESCE(r.publisher, '-1') = p.v""",
    "mean_baseline": "SELECT user_id, book_id, ROUND(rating_predict, 6) AS rating_predict FROM mean_submission",
    "clip_predictions": """
        SELECT user_id, raw, CASE WHEN raw < 0 THEN 0 WHEN raw > 10 THEN 10 ELSE raw END AS rating_predict
        FROM (SELECT c_custkey AS user_id,
                     CASE WHEN c_nationkey % 7 = 3 THEN NULL ELSE c_acctbal / CAST(800 AS DOUBLE) END AS raw
              FROM customer)""",
    "score_by_stage": _scores("mean_submission", "solution"),
    "regression_metrics": f"""
        SELECT COUNT(*) AS n, ROUND(SQRT(AVG(e * e)), 6) AS rmse, ROUND(AVG(ABS(e)), 6) AS mae
        FROM (SELECT b.m - r.rating AS e
              FROM rated r JOIN (SELECT book_id, AVG(rating) AS m FROM rated WHERE "timestamp" <= {RATED_CUT}
                                 GROUP BY book_id) b ON r.book_id = b.book_id
              WHERE r."timestamp" > {RATED_CUT})""",
    "prediction_stats": """
        SELECT COUNT(*) AS n, ROUND(MIN(rating_predict), 6) AS min, ROUND(MAX(rating_predict), 6) AS max,
               ROUND(AVG(rating_predict), 6) AS mean FROM mean_submission""",
    "source_counts": """
        SELECT source, COUNT(*) AS n_rows, CAST(9 AS BIGINT) AS n_features FROM merged GROUP BY source""",
    "validate_submission": _submission_report("mean_submission", "clean")
    + "\nUNION ALL\n"
    + _submission_report("broken_submission", "broken"),
    "validate_solution": _solution_report("solution", "clean")
    + "\nUNION ALL\n"
    + _solution_report("broken_solution", "broken"),
    "check_submission": _upload_report("mean_submission", "clean")
    + "\nUNION ALL\n"
    + _upload_report("broken_submission", "broken"),
    "pair_diff": """
        SELECT 'missing' AS kind, user_id, book_id
        FROM (SELECT user_id, book_id FROM solution EXCEPT SELECT user_id, book_id FROM broken_submission)
        UNION ALL
        SELECT 'extra', user_id, book_id
        FROM (SELECT user_id, book_id FROM broken_submission EXCEPT SELECT user_id, book_id FROM solution)""",
    "lost_pairs": """
        SELECT user_id, book_id, stage FROM solution t
        WHERE NOT EXISTS (SELECT 1 FROM broken_submission s WHERE s.user_id = t.user_id AND s.book_id = t.book_id)""",
    "lost_pair_examples": """
        SELECT user_id, book_id, stage
        FROM (SELECT user_id, book_id, stage, ROW_NUMBER() OVER (PARTITION BY stage ORDER BY user_id, book_id) AS rn
              FROM solution t
              WHERE NOT EXISTS (SELECT 1 FROM broken_submission s
                                WHERE s.user_id = t.user_id AND s.book_id = t.book_id))
        WHERE rn <= 5""",
    "repeated_pairs": """
        SELECT user_id, book_id, COUNT(*) - 1 AS surplus FROM broken_submission
        GROUP BY user_id, book_id HAVING COUNT(*) > 1""",
    "out_of_range_ratings": """
        SELECT user_id, book_id, rating FROM broken_solution
        WHERE TRY_CAST(rating AS DOUBLE) < 0 OR TRY_CAST(rating AS DOUBLE) > 10""",
    "scan_csv_roundtrip": """
        SELECT CAST(user_id AS INT) AS user_id, CAST(book_id AS INT) AS book_id, has_read, rating, "timestamp"
        FROM train_raw""",
    "scan_test_roundtrip": "SELECT CAST(user_id AS INT) AS user_id, CAST(book_id AS INT) AS book_id FROM solution",
    "scan_users_roundtrip": "SELECT CAST(user_id AS INT) AS user_id, gender, age FROM users",
    "scan_book_genres_roundtrip": """
        SELECT CAST(book_id AS INT) AS book_id, CAST(genre_id AS SMALLINT) AS genre_id FROM book_genres""",
    "scan_genres_roundtrip": """
        SELECT genre_id, 'genre_' || genre_id AS genre_name, COUNT(DISTINCT book_id) AS books_count
        FROM book_genres GROUP BY genre_id""",
    "scan_solution_roundtrip": """
        SELECT CAST(user_id AS INT) AS user_id, CAST(book_id AS INT) AS book_id, CAST(rating AS DOUBLE) AS rating, stage
        FROM solution""",
    "validation_examples": """
        SELECT * FROM (WITH given AS (SELECT user_id, book_id, COUNT(*) AS n FROM broken_submission GROUP BY ALL),
        lost AS (SELECT * FROM solution t WHERE NOT EXISTS (
            SELECT 1 FROM given s WHERE s.user_id = t.user_id AND s.book_id = t.book_id)),
        flagged AS (
            SELECT 'submission' AS input, 'no_duplicates' AS "check", NULL AS stage, user_id, book_id, n - 1 AS bad
            FROM given WHERE n > 1
            UNION ALL SELECT 'submission', 'no_missing_pairs', NULL, user_id, book_id, 1 FROM lost
            UNION ALL SELECT 'submission', 'lost', stage, user_id, book_id, 1 FROM lost
            UNION ALL SELECT 'submission', 'no_extra_pairs', NULL, user_id, book_id, 1 FROM given s
            WHERE NOT EXISTS (SELECT 1 FROM solution t WHERE s.user_id = t.user_id AND s.book_id = t.book_id)
            UNION ALL SELECT 'solution', 'no_duplicates', NULL, user_id, book_id, COUNT(*) - 1 FROM broken_solution
            GROUP BY user_id, book_id HAVING COUNT(*) > 1
            UNION ALL SELECT 'solution', 'in_range', NULL, user_id, book_id, COUNT(*) FROM broken_solution
            WHERE TRY_CAST(rating AS DOUBLE) < 0 OR TRY_CAST(rating AS DOUBLE) > 10 GROUP BY user_id, book_id
        )
        SELECT input, "check", stage, CAST(bad_rows AS BIGINT) AS bad_rows, CAST(place AS INT) AS place, user_id, book_id
        FROM (SELECT *, SUM(bad) OVER (PARTITION BY input, "check", stage) AS bad_rows,
                     ROW_NUMBER() OVER (PARTITION BY input, "check", stage ORDER BY user_id, book_id) AS place
              FROM flagged) WHERE place <= 5)""",
    "scan_books_roundtrip": """
        SELECT CAST(book_id AS INT) AS book_id, title, author_id, author_name, publication_year, language, publisher,
               avg_rating FROM books""",
    "scan_descriptions_roundtrip": """
        SELECT CAST(book_id AS INT) AS book_id, LENGTH(description) AS n_chars, md5(description) AS description_md5
        FROM descriptions""",
    "submission": """
        SELECT CAST(user_id AS INT) AS user_id, CAST(book_id AS INT) AS book_id,
               ROUND(rating_predict, 6) AS rating_predict FROM mean_submission""",
    "vocabulary_roundtrip": "SELECT term, idx, ROUND(idf, 6) AS idf FROM vocabulary",
    "features_parquet_roundtrip": f"SELECT {PREPARED_6} FROM prepared",
}


def oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}
