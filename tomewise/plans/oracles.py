"""The SQL that says what each registered query has to return."""

RATINGS_RAW = """
ratings_raw AS (
  SELECT CAST(o_custkey AS INTEGER) AS user_id, CAST(l_partkey AS INTEGER) AS book_id,
         CAST(floor((l_quantity - 1) / 10) + 1 AS DOUBLE) AS rating,
         o_orderdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

RATINGS = f"""{RATINGS_RAW},
ratings AS (
  SELECT user_id, book_id, rating FROM (
    SELECT *, row_number() OVER (
      PARTITION BY user_id, book_id
      ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC,
               l_quantity DESC, l_discount DESC, l_tax DESC) AS copy
    FROM ratings_raw) WHERE copy = 1
)"""

GR_BOOKS = """
gr_books AS (
  SELECT CAST(p_partkey AS INTEGER) AS gr_id,
         CAST(100000 + 7 * p_partkey AS INTEGER) AS ext_book_id,
         lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn10, p_type
  FROM part
)"""

ECONOMY = f"""{GR_BOOKS},
economy AS (SELECT gr_id, ext_book_id, isbn10 FROM gr_books WHERE p_type = 'ECONOMY')"""

BOOKS = """
books AS (
  SELECT CAST(100000 + 7 * p_partkey AS INTEGER) AS ext_book_id, p_name AS title,
         p_brand AS author, CAST(1950 + p_size AS INTEGER) AS publication_year,
         CASE WHEN p_size % 5 <> 0
              THEN 'https://covers.example/' || CAST(p_partkey AS VARCHAR) END AS image_url
  FROM part
)"""

CATALOG = f"""{GR_BOOKS}, {BOOKS},
catalog AS (
  SELECT gr_id AS book_id, ext_book_id, title,
         coalesce(image_url, 'no-cover.png') AS image_url
  FROM gr_books LEFT JOIN books USING (ext_book_id)
)"""

USERS = """
users AS (SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS username FROM customer)"""

NEW_RATINGS = """
incoming AS (
  SELECT event_id AS arrival,
         CASE WHEN user_id % 3 = 0 THEN 'reader_' || CAST(user_id AS VARCHAR)
              ELSE 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS username,
         CAST(100000 + 7 * CAST(props->>'$.k' AS INTEGER) AS INTEGER) AS ext_book_id,
         lpad(props->>'$.k', 10, '0') AS isbn10,
         CAST(least(5, floor(value / 20) + 1) AS INTEGER) AS rating
  FROM events
)"""

NEW_USERS = f"""{USERS}, {NEW_RATINGS},
new_users AS (
  SELECT CAST((SELECT coalesce(max(id), 0) FROM users)
              + row_number() OVER (ORDER BY first_arrival, username) AS INTEGER) AS user_id,
         username
  FROM (SELECT username, min(arrival) AS first_arrival FROM incoming GROUP BY username)
  WHERE username NOT IN (SELECT username FROM users)
)"""

NEW_BOOKS = """
new_books AS (
  SELECT CAST((SELECT coalesce(max(gr_id), 0) FROM economy)
              + row_number() OVER (ORDER BY first_arrival, ext_book_id) AS INTEGER) AS gr_id,
         ext_book_id, isbn10
  FROM (SELECT ext_book_id, min(arrival) AS first_arrival, min_by(isbn10, arrival) AS isbn10
        FROM incoming GROUP BY ext_book_id)
  WHERE ext_book_id NOT IN (SELECT ext_book_id FROM economy)
)"""

INGESTED = f"""{RATINGS}, {NEW_USERS}, {ECONOMY}, {NEW_BOOKS},
user_ids AS (SELECT id AS user_id, username FROM users UNION ALL FROM new_users),
book_ids AS (
  SELECT gr_id, ext_book_id FROM economy UNION ALL SELECT gr_id, ext_book_id FROM new_books),
ingested AS (
  SELECT CAST((SELECT count(*) FROM ratings)
              + row_number() OVER (ORDER BY arrival) AS BIGINT) AS col_id,
         user_id, CAST(rating AS DOUBLE) AS rating, gr_id AS book_id, username, isbn10
  FROM (SELECT * FROM incoming WHERE rating BETWEEN 1 AND 5)
  JOIN user_ids USING (username) JOIN book_ids USING (ext_book_id)
)"""

SCORES = """
vectors AS (
  SELECT CAST(vec_id AS INTEGER) AS id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings),
scores AS (
  SELECT u.id AS user_id, b.id AS book_id,
         round(list_dot_product(u.features, b.features), 6) AS prediction
  FROM vectors u CROSS JOIN vectors b
)"""


MARKED = """
marked AS (
  SELECT user_id, book_id,
         (CAST(user_id AS BIGINT) * 31 + CAST(book_id AS BIGINT) * 17) % 10 AS bucket
  FROM ratings)"""


HASHED = """
hashed AS (
  SELECT user_id, book_id,
         CAST('0x' || substr(md5(user_id || ':' || book_id || ':7'), 1, 8) AS BIGINT) % 10000 AS bucket
  FROM ratings)"""


def _best(scores: str, name: str = "recs") -> str:
    return f"""
{name} AS (
  SELECT user_id, book_id, prediction FROM (
    SELECT *, row_number() OVER (
      PARTITION BY user_id ORDER BY prediction DESC, book_id) AS place
    FROM {scores}) WHERE place <= 10
)"""


FIXED_RECS = f"{SCORES}, {_best('scores')}"

SERVED = f"""{RATINGS}, {FIXED_RECS}, {CATALOG},
served AS (
  SELECT user_id, ext_book_id, title, image_url, prediction
  FROM recs LEFT JOIN catalog USING (book_id)
  WHERE book_id IN (SELECT book_id FROM ratings)
)"""

UNSEEN = """
FROM recs WHERE NOT EXISTS (
  SELECT 1 FROM ratings r WHERE r.user_id = recs.user_id AND r.book_id = recs.book_id)"""


def _describe(value: str, source: str, decimals: int = 6) -> str:
    statistics = {
        "count": f"CAST(count({value}) AS DOUBLE)",
        "mean": f"avg({value})",
        "std": f"stddev_samp({value})",
        "min": f"min({value})",
        "25%": f"quantile_cont({value}, 0.25)",
        "50%": f"quantile_cont({value}, 0.5)",
        "75%": f"quantile_cont({value}, 0.75)",
        "max": f"max({value})",
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS statistic, CAST(round({sql}, {decimals}) AS DOUBLE) AS value"
        f" FROM {source}"
        for name, sql in statistics.items()
    )


LOOKUP_LOAD = f"""WITH {ECONOMY}
        SELECT gr_id, ext_book_id, isbn10 FROM (
          SELECT CAST(l_partkey AS INTEGER) AS gr_id,
                 CAST(100000 + 7 * l_partkey AS INTEGER) AS ext_book_id,
                 lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS isbn10,
                 row_number() OVER (PARTITION BY l_partkey
                                    ORDER BY l_orderkey, l_linenumber, l_suppkey) AS place
          FROM lineitem)
        WHERE place = 1 AND gr_id NOT IN (SELECT gr_id FROM economy)"""


COUNTS_AFTER_STREAM = f"""WITH {INGESTED},
        pairs AS (SELECT user_id, book_id FROM ratings UNION SELECT user_id, book_id FROM ingested)
        SELECT user_id,
               least(10, (SELECT count(DISTINCT book_id) FROM pairs) - count(*)) AS recs,
               CAST(0 AS BIGINT) AS rated
        FROM pairs GROUP BY user_id"""

ORACLES = {
    "rating_counts": f"""WITH {RATINGS}
        SELECT '# of Ratings' AS characteristic, count(rating) AS count FROM ratings
        UNION ALL SELECT '# of Users', count(DISTINCT user_id) FROM ratings
        UNION ALL SELECT '# of Books', count(DISTINCT book_id) FROM ratings""",
    "rating_describe": f"WITH {RATINGS} {_describe('rating', 'ratings')}",
    "price_describe": _describe("l_extendedprice", "lineitem", 3),
    "rating_histogram": f"""WITH {RATINGS}
        SELECT CAST(edge AS DOUBLE) AS bin,
               count(rating) AS count
        FROM (SELECT unnest([1, 2, 3, 4, 5]) AS edge)
        LEFT JOIN ratings ON rating >= edge
          AND (rating < edge + 1 OR (edge = 5 AND rating = 6))
        GROUP BY edge""",
    "rating_sparsity": f"""WITH {RATINGS},
        n AS (SELECT count(rating) AS ratings, count(DISTINCT user_id) AS users,
                     count(DISTINCT book_id) AS books FROM ratings)
        SELECT ratings, users, books,
               round((1.0::DOUBLE - ratings / (users::DOUBLE * books)) * 100, 2) AS sparsity_pct
        FROM n""",
    "rating_mode": f"""WITH {RATINGS}
        SELECT round(avg(rating), 6) AS mean_rating,
               (SELECT rating FROM ratings GROUP BY rating
                ORDER BY count(*) DESC, rating LIMIT 1) AS modal_rating
        FROM ratings""",
    "top_rated_books": f"""WITH {RATINGS}, {CATALOG}
        SELECT book_id, title, round(avg(rating), 6) AS avg_rating, count(rating) AS ratings
        FROM ratings LEFT JOIN catalog USING (book_id)
        GROUP BY book_id, title HAVING count(rating) >= 3
        ORDER BY avg(rating) DESC, count(rating) DESC, book_id LIMIT 5""",
    "active_users": f"""WITH {RATINGS_RAW}
        SELECT user_id, count(DISTINCT book_id) AS books FROM ratings_raw
        GROUP BY user_id HAVING count(DISTINCT book_id) >= 10""",
    "rmse_fixed": f"""WITH {RATINGS},
        means AS (SELECT user_id, avg(rating) AS prediction FROM ratings GROUP BY user_id)
        SELECT round(sqrt(avg(pow(prediction - rating, 2))), 6) AS rmse, count(*) AS scored
        FROM ratings JOIN means USING (user_id)""",
    "dedupe_ratings": f"WITH {RATINGS} SELECT user_id, book_id, rating FROM ratings",
    "union_ratings": f"""WITH {INGESTED}
        SELECT user_id, book_id, rating FROM ratings
        UNION ALL SELECT user_id, book_id, rating FROM ingested""",
    "ratings_load": f"""WITH {RATINGS}, {USERS}, {GR_BOOKS}
        SELECT row_number() OVER (ORDER BY user_id, book_id) AS col_id,
               user_id, rating, book_id, username, isbn10
        FROM ratings LEFT JOIN users ON user_id = id LEFT JOIN gr_books ON book_id = gr_id""",
    "rating_file_load": f"WITH {RATINGS} SELECT book_id, user_id, rating FROM ratings",
    "book_file_load": f"""WITH {BOOKS}
        SELECT ext_book_id AS id,
               CASE ext_book_id % 3 WHEN 0 THEN 'The "' || title || '", by ' || author
                    WHEN 1 THEN title || chr(10) || 'Volume ' || author ELSE title END AS title
        FROM books""",
    "lookup_file_load": LOOKUP_LOAD,
    "ratings_quarantine": f"""WITH {RATINGS}, {USERS}, {GR_BOOKS},
        t AS (
          SELECT row_number() OVER (ORDER BY user_id, book_id) AS col_id,
                 user_id, rating, book_id, username, isbn10
          FROM ratings LEFT JOIN users ON user_id = id LEFT JOIN gr_books ON book_id = gr_id)
        SELECT col_id, user_id, rating, book_id, username, isbn10, CAST(NULL AS VARCHAR) AS reject
        FROM t WHERE col_id % 11 <> 0 AND col_id % 13 <> 0
        UNION ALL
        SELECT NULL, NULL, NULL, NULL, NULL, NULL, concat_ws(',', CAST(col_id AS VARCHAR),
               CASE WHEN col_id % 11 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END,
               CASE WHEN col_id % 13 = 0 THEN 'x' ELSE CAST(rating AS VARCHAR) END,
               CAST(book_id AS VARCHAR), username, isbn10)
        FROM t WHERE col_id % 11 = 0 OR col_id % 13 = 0""",
    "lookup_load": LOOKUP_LOAD,
    "profile_view": f"""WITH {RATINGS}, {CATALOG}
        SELECT user_id, ext_book_id, title, image_url, rating
        FROM ratings LEFT JOIN catalog USING (book_id)""",
    "lookup_misses": f"""WITH {RATINGS}, {ECONOMY}
        SELECT count(*) AS misses FROM ratings
        WHERE book_id NOT IN (SELECT gr_id FROM economy)""",
    "book_search": f"""WITH {BOOKS}
        SELECT ext_book_id, title, author, image_url FROM books
        WHERE contains(lower(title), 'ring')""",
    "book_search_author": f"""WITH {BOOKS}
        SELECT ext_book_id, title, author, image_url FROM books
        WHERE contains(lower(title), 'widget') AND contains(lower(author), 'brand#1')""",
    "book_detail": f"""WITH {BOOKS}
        SELECT ext_book_id, title, author, publication_year,
               coalesce(image_url, 'no-cover.png') AS image_url,
               ext_book_id IS NOT NULL AS rateable
        FROM books""",
    "book_by_id": f"""WITH {BOOKS}
        SELECT ext_book_id, title, author, publication_year,
               coalesce(image_url, 'no-cover.png') AS image_url,
               ext_book_id IS NOT NULL AS rateable
        FROM books WHERE ext_book_id = 100294""",
    "book_links": f"""WITH {BOOKS}
        SELECT ext_book_id,
               'https://books.example/search?q=' || replace(url_encode(title), '%20', '+') AS url,
               'By: ' || author AS byline
        FROM books""",
    "xml_books": f"""WITH {BOOKS}
        SELECT ext_book_id, isbn10, title, author, publication_year, image_url
        FROM books JOIN (
          SELECT CAST(100000 + 7 * p_partkey AS INTEGER) AS ext_book_id,
                 lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn10 FROM part)
        USING (ext_book_id)""",
    "xml_search": f"WITH {BOOKS} SELECT ext_book_id, title, author, image_url FROM books",
    "alloc_user_ids": f"WITH {NEW_USERS} SELECT user_id, username FROM new_users",
    "alloc_book_ids": f"""WITH {NEW_RATINGS}, {ECONOMY}, {NEW_BOOKS}
        SELECT gr_id, ext_book_id, isbn10 FROM new_books""",
    "dense_user_ids": f"""WITH {USERS}
        SELECT username, CAST(row_number() OVER (ORDER BY username) AS INTEGER) AS dense_id
        FROM (SELECT DISTINCT username FROM users)""",
    "user_directory": f"""WITH {NEW_USERS}
        SELECT id, username FROM users UNION ALL SELECT user_id, username FROM new_users""",
    "ingest_ratings": f"WITH {INGESTED} SELECT * FROM ingested",
    "ingest_rejects": f"""WITH {NEW_RATINGS}
        SELECT arrival, username, ext_book_id, isbn10,
               CAST(floor(value / 20) AS INTEGER) AS rating
        FROM incoming JOIN events ON arrival = event_id
        WHERE CAST(floor(value / 20) AS INTEGER) NOT BETWEEN 1 AND 5""",
    "fixed_factor_topk": f"WITH {FIXED_RECS} SELECT * FROM recs",
    "fixed_factor_known": f"""WITH {RATINGS}, {FIXED_RECS}
        SELECT user_id, book_id, prediction, rating
        FROM recs LEFT JOIN ratings USING (user_id, book_id)""",
    "fixed_factor_unseen_left_null": f"""WITH {RATINGS}, {FIXED_RECS}
        SELECT user_id, book_id, prediction
        FROM recs LEFT JOIN ratings USING (user_id, book_id) WHERE rating IS NULL""",
    "fixed_factor_unseen_anti": f"""WITH {RATINGS}, {FIXED_RECS}
        SELECT user_id, book_id, prediction {UNSEEN}""",
    "fixed_factor_unseen_exact": f"""WITH {RATINGS}, {SCORES},
        unseen AS (SELECT * FROM scores ANTI JOIN ratings USING (user_id, book_id)),
        {_best('unseen')} SELECT * FROM recs""",
    "flatten_recs": f"WITH {FIXED_RECS} SELECT * FROM recs",
    "recs_serving": f"WITH {SERVED} SELECT * FROM served",
    "segment_recs": f"""WITH {SERVED} SELECT * FROM served
        WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "new_user_recs": f"""WITH {FIXED_RECS} SELECT * FROM recs
        WHERE user_id > (SELECT max(user_id) // 2 FROM recs)""",
    "one_user_recs": f"WITH {FIXED_RECS} SELECT * FROM recs WHERE user_id = 42",
    "als_unseen_counts": f"""WITH {RATINGS}
        SELECT user_id,
               least(10, (SELECT count(DISTINCT book_id) FROM ratings) - count(*)) AS recs,
               CAST(0 AS BIGINT) AS rated
        FROM ratings GROUP BY user_id""",
    "als_grid_scored": f"""WITH {RATINGS}, {MARKED},
        training AS (SELECT * FROM marked WHERE bucket < 6),
        scored AS (
          SELECT count(*) AS scored FROM marked WHERE bucket IN (6, 7)
            AND user_id IN (SELECT user_id FROM training)
            AND book_id IN (SELECT book_id FROM training))
        SELECT CAST(grid_pos AS INTEGER) AS grid_pos, CAST(rank AS INTEGER) AS rank,
               CAST(reg AS DOUBLE) AS reg, scored
        FROM (VALUES (0, 10, 0.15), (1, 10, 0.2), (2, 10, 0.25), (3, 20, 0.15), (4, 20, 0.2), (5, 20, 0.25),
                     (6, 50, 0.15), (7, 50, 0.2), (8, 50, 0.25), (9, 70, 0.15), (10, 70, 0.2), (11, 70, 0.25)
             ) g(grid_pos, rank, reg),
             scored""",
    "als_holdout_scored": f"""WITH {RATINGS}, {HASHED},
        training AS (SELECT * FROM hashed WHERE bucket < 6000)
        SELECT count(*) AS scored FROM hashed WHERE bucket >= 8000
          AND user_id IN (SELECT user_id FROM training)
          AND book_id IN (SELECT book_id FROM training)""",
    "als_filter_after_counts": "SELECT CAST(0 AS BIGINT) AS rated, CAST(0 AS BIGINT) AS over_limit",
    "hash_split_sizes": f"""WITH {RATINGS}, {HASHED}
        SELECT 'training' AS part, count(*) AS rows FROM hashed WHERE bucket < 6000
        UNION ALL SELECT 'validation', count(*) FROM hashed WHERE bucket >= 6000 AND bucket < 8000
        UNION ALL SELECT 'test', count(*) FROM hashed WHERE bucket >= 8000""",
    "key_split_sizes": f"""WITH {RATINGS}, {MARKED}
        SELECT 'training' AS part, count(*) AS rows FROM marked WHERE bucket < 6
        UNION ALL SELECT 'validation', count(*) FROM marked WHERE bucket IN (6, 7)
        UNION ALL SELECT 'test', count(*) FROM marked WHERE bucket > 7""",
    "stream_refresh": f"WITH {INGESTED} SELECT * FROM ingested",
    "stream_redelivered": f"WITH {INGESTED} SELECT * FROM ingested",
    "stream_rec_counts": COUNTS_AFTER_STREAM,
    "stream_foldin_counts": COUNTS_AFTER_STREAM,
    "foldin_half_step": f"""WITH {RATINGS}
        SELECT count(DISTINCT user_id) AS users, CAST(0 AS BIGINT) AS differing FROM ratings""",
}
