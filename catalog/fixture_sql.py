"""DuckDB text of the fixture tables and a helper that puts the needed ones in front of a query."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "unfiltered_log": """
        SELECT o_custkey AS user_id, l_partkey AS book_id,
               CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS has_read,
               l_quantity / CAST(5 AS DOUBLE) AS rating, l_shipdate AS "timestamp", l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "interaction_log": """
        SELECT user_id, book_id, has_read,
               CASE WHEN has_read = 0 THEN CAST(0 AS DOUBLE) ELSE rating END AS rating, "timestamp",
               CASE WHEN "timestamp" <= TIMESTAMP '2000-12-31 00:00:00' THEN 1 ELSE 2 END AS chunk
        FROM unfiltered_log""",
    "train_raw": """
        SELECT user_id, book_id, has_read, rating, "timestamp" FROM interaction_log
        WHERE chunk = 1 AND book_id % 41 <> 7""",
    "rated": """SELECT * FROM train_raw WHERE has_read = 1""",
    "warm": """
        SELECT user_id FROM train_raw GROUP BY user_id
        HAVING SUM(CASE WHEN has_read = 1 THEN 1 ELSE 0 END) >= 1
            OR SUM(CASE WHEN has_read = 0 THEN 1 ELSE 0 END) >= 3""",
    "solution": """
        SELECT user_id, book_id, rating, CASE WHEN user_id % 2 = 0 THEN 'public' ELSE 'private' END AS stage
        FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY user_id
                                             ORDER BY "timestamp" DESC, book_id DESC, rating DESC) AS rn
              FROM interaction_log r WHERE chunk = 2 AND has_read = 1) x
        WHERE rn = 1 AND user_id IN (SELECT user_id FROM warm)""",
    "users": """
        SELECT c_custkey AS user_id,
               CASE c_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '2' END AS gender,
               CASE WHEN c_acctbal < 0 THEN NULL
                    ELSE CAST(12 + FLOOR(c_acctbal / CAST(125 AS DOUBLE)) AS DOUBLE) END AS age
        FROM customer WHERE c_custkey % 53 <> 5""",
    "books": """
        SELECT p_partkey AS book_id, p_name AS title, CAST(SUBSTRING(p_brand, 7) AS INT) AS author_id,
               p_brand AS author_name,
               CAST(CASE WHEN p_size = 13 THEN NULL ELSE 1970 + p_size END AS DOUBLE) AS publication_year,
               p_type AS language,
               CASE WHEN p_size % 10 = 9 THEN NULL ELSE CAST(p_size % 7 AS VARCHAR) END AS publisher,
               CASE WHEN p_partkey % 17 = 4 THEN NULL
                    ELSE CAST(p_partkey % 100 AS DOUBLE) / CAST(10 AS DOUBLE) END AS avg_rating,
               0 AS row_order
        FROM part WHERE p_partkey % 43 <> 11
        UNION ALL
        SELECT p_partkey, p_name, 99, 'second copy', CAST(1900 AS DOUBLE), p_type, '9', CAST(1 AS DOUBLE), 1
        FROM part WHERE p_partkey % 47 = 3""",
    "first_books": """
        SELECT book_id, title, author_id, author_name, publication_year, language, publisher, avg_rating
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY book_id ORDER BY row_order) AS rn FROM books) WHERE rn = 1""",
    "book_genres": """
        SELECT DISTINCT l_partkey AS book_id, CAST(l_suppkey % 12 AS INT) AS genre_id
        FROM lineitem WHERE l_partkey % 19 <> 6""",
    "descriptions": """
        SELECT doc_id AS book_id, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE text END AS description, 0 AS row_order
        FROM documents
        UNION ALL
        SELECT doc_id, CONCAT(text, ' second copy'), 1 FROM documents WHERE doc_id % 31 = 2""",
    "first_texts": """
        SELECT book_id, COALESCE(description, '') AS description
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY book_id ORDER BY row_order) AS rn FROM descriptions)
        WHERE rn = 1""",
    "last_texts": """
        SELECT book_id, COALESCE(description, '') AS description
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY book_id ORDER BY row_order DESC) AS rn FROM descriptions)
        WHERE rn = 1""",
    "vectors": """SELECT vec_id AS book_id, embedding FROM embeddings""",
    "both_sources": """
        SELECT user_id, book_id, has_read, rating, "timestamp", 'train' AS source FROM rated
        UNION ALL
        SELECT user_id, book_id, NULL, NULL, NULL, 'test' FROM solution""",
    "merged": """
        SELECT b.*, u.gender, u.age, k.title, k.author_id, k.author_name, k.publication_year, k.language,
               k.publisher, k.avg_rating
        FROM both_sources b LEFT JOIN users u ON b.user_id = u.user_id
        LEFT JOIN first_books k ON b.book_id = k.book_id""",
    "genre_counts": """
        SELECT book_id, COUNT(genre_id) AS book_genres_count FROM book_genres GROUP BY book_id""",
    "user_stats": """
        SELECT user_id, AVG(rating) AS user_mean_rating, COUNT(rating) AS user_ratings_count
        FROM rated GROUP BY user_id""",
    "book_stats": """
        SELECT book_id, AVG(rating) AS book_mean_rating, COUNT(rating) AS book_ratings_count
        FROM rated GROUP BY book_id""",
    "with_genres": """
        SELECT m.*, g.book_genres_count FROM merged m LEFT JOIN genre_counts g ON m.book_id = g.book_id""",
    "prepared": """
        SELECT user_id, book_id, has_read, rating, "timestamp", source, COALESCE(gender, '-1') AS gender,
               COALESCE(age, (SELECT MEDIAN(age) FROM merged)) AS age, title, COALESCE(author_id, -1) AS author_id,
               author_name, COALESCE(publication_year, -1) AS publication_year, COALESCE(language, '-1') AS language,
               COALESCE(publisher, '-1') AS publisher,
               COALESCE(avg_rating, (SELECT AVG(rating) FROM rated)) AS avg_rating,
               COALESCE(book_genres_count, 0) AS book_genres_count
        FROM with_genres""",
    "prepared_train": """SELECT * FROM prepared WHERE source = 'train'""",
    "cut": """
        SELECT "timestamp" AS d
        FROM (SELECT "timestamp", ROW_NUMBER() OVER (ORDER BY "timestamp") - 1 AS place, COUNT(*) OVER () AS n
              FROM prepared_train) WHERE place = CAST(FLOOR(n * CAST(0.8 AS DOUBLE)) AS BIGINT)""",
    "early": """SELECT * FROM prepared_train WHERE "timestamp" <= (SELECT d FROM cut)""",
    "late": """SELECT * FROM prepared_train WHERE "timestamp" > (SELECT d FROM cut)""",
    "mean_submission": """
        SELECT s.user_id, s.book_id,
               COALESCE(b.book_mean_rating, (SELECT AVG(rating) FROM rated)) AS rating_predict
        FROM solution s LEFT JOIN book_stats b ON s.book_id = b.book_id""",
    "broken_submission": """
        SELECT user_id, book_id, CASE WHEN user_id % 13 = 1 THEN NULL WHEN user_id % 17 = 2 THEN 'n/a'
                                      WHEN user_id % 19 = 3 THEN '10.5' ELSE '5.25' END AS rating_predict
        FROM solution WHERE user_id % 9 <> 0
        UNION ALL SELECT user_id, book_id, '5.0' FROM solution WHERE user_id % 10 = 3
        UNION ALL SELECT user_id, book_id + 1000000, '5.0' FROM solution WHERE user_id % 11 = 5""",
    "broken_solution": """
        SELECT user_id, book_id, CASE WHEN user_id % 13 = 1 THEN NULL WHEN user_id % 17 = 2 THEN 'bad'
                                      WHEN user_id % 19 = 3 THEN '11' WHEN user_id % 23 = 4 THEN '-1'
                                      ELSE '7.5' END AS rating,
               CASE WHEN user_id % 7 = 1 THEN NULL WHEN user_id % 7 = 2 THEN 'other' ELSE 'public' END AS stage
        FROM solution
        UNION ALL SELECT user_id, book_id, '1.0', 'public' FROM solution WHERE user_id % 10 = 3""",
    # Text: tokens in text order, terms of a text, and the vocabulary of the train books.
    "fit_texts": """
        SELECT row_number() OVER () AS doc, COALESCE(description, '') AS description FROM descriptions
        WHERE book_id IN (SELECT book_id FROM rated)""",
    "fit_words": """
        SELECT doc, regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}') AS w FROM fit_texts""",
    "fit_terms": """
        SELECT doc, unnest(w) AS term FROM fit_words
        UNION ALL
        SELECT doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM fit_words""",
    "kept_terms": """
        SELECT term, tf, df, n
        FROM (SELECT term, COUNT(*) AS tf, COUNT(DISTINCT doc) AS df, (SELECT COUNT(*) FROM fit_texts) AS n
              FROM fit_terms GROUP BY term)
        WHERE df >= 2 AND df <= CAST(0.95 AS DOUBLE) * n
        ORDER BY tf DESC, term LIMIT 10000""",
    "vocabulary": """
        SELECT term, ROW_NUMBER() OVER (ORDER BY term) - 1 AS idx, tf, df,
               LN(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1.0 AS idf FROM kept_terms""",
    "text_words": """
        SELECT book_id, regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}') AS w FROM last_texts""",
    "text_terms": """
        SELECT book_id, unnest(w) AS term FROM text_words
        UNION ALL
        SELECT book_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM text_words""",
    "raw_weights": """
        SELECT book_id, idx, COUNT(*) * idf AS x FROM text_terms JOIN vocabulary USING (term)
        GROUP BY book_id, idx, idf""",
}


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [name for name in VIEWS if name in words]


def with_views(sql: str) -> str:
    """`sql` with the fixture tables it needs, directly or through others, as common table expressions."""
    needed: set[str] = set()
    todo = _used(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _used(VIEWS[name]) if n != name]
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {ctes}\n{sql}" if ctes else sql
