"""The SQL of ``queries_serving``."""

from tomewise.operators.search_index import B, K1
from tomewise.plans.oracles import (
    BOOKS, FIXED_RECS, HASHED, NEW_RATINGS, ORACLES, RATINGS, RATINGS_RAW, SCORES, USERS,
)
from tomewise.plans.queries_serving import (
    CORE_BOOKS, CORE_USERS, METRIC_CUTOFFS, RELEVANT, SEARCHED, TITLES_FOUND,
)

_WORDS = r"list_transform(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda x: x)"
BM25 = rf"""{BOOKS},
doc AS (SELECT ext_book_id, title, author, {_WORDS.format("concat_ws(' ', title, author)")} AS words FROM books),
tf AS (SELECT ext_book_id, term, len(any_value(words)) AS length, count(*) AS tf
  FROM (SELECT ext_book_id, words, unnest(words) AS term FROM doc) GROUP BY ext_book_id, term),
df AS (SELECT term, ln(1 + ((SELECT count(*) FROM doc) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY term),
average AS (SELECT sum(len(words))::DOUBLE / count(*) AS size FROM doc),
asked AS (SELECT DISTINCT query_id, unnest({_WORDS.format("text")}) AS term FROM query),
scored AS (SELECT query_id, ext_book_id,
    sum(idf * tf * ({K1}::DOUBLE + 1) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * length / size))) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term), average GROUP BY query_id, ext_book_id)"""

JUDGED = f"""{RATINGS}, {HASHED}, {SCORES},
parts AS (SELECT user_id, book_id, rating, bucket FROM ratings JOIN hashed USING (user_id, book_id)),
training AS (SELECT * FROM parts WHERE bucket < 6000),
good AS (SELECT user_id, book_id, rating AS gain FROM parts WHERE bucket >= 8000 AND rating >= {RELEVANT}),
unseen AS (SELECT * FROM scores ANTI JOIN training USING (user_id, book_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, book_id) AS place FROM unseen),
everyone AS (SELECT DISTINCT user_id FROM scores UNION SELECT user_id FROM parts WHERE bucket >= 8000)"""


def _metrics(k: int) -> str:
    return f"""
hits{k} AS (SELECT user_id, place, gain, row_number() OVER (PARTITION BY user_id ORDER BY place) AS found
  FROM ranked JOIN good USING (user_id, book_id) WHERE place <= {k}),
sums{k} AS (SELECT user_id, count(*) AS hits, sum(found / place) AS precisions, sum((pow(2, gain) - 1) / log2(place + 1)) AS dcg
  FROM hits{k} GROUP BY user_id),
ideal{k} AS (SELECT user_id, sum((pow(2, gain) - 1) / log2(nth + 1)) AS ideal FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, book_id) AS nth FROM good) WHERE nth <= {k} GROUP BY user_id),
each{k} AS (SELECT user_id, coalesce(n, 0) AS relevant, coalesce(hits, 0) AS hits, coalesce(hits, 0) / {k} AS precision,
    CASE WHEN n > 0 THEN coalesce(hits, 0) / n END AS recall,
    CASE WHEN n > 0 THEN coalesce(precisions / least(n, {k}), 0) END AS average_precision,
    CASE WHEN n > 0 THEN coalesce(dcg / ideal, 0) END AS ndcg
  FROM everyone LEFT JOIN (SELECT user_id, count(*) AS n FROM good GROUP BY user_id) USING (user_id)
    LEFT JOIN sums{k} USING (user_id) LEFT JOIN ideal{k} USING (user_id))"""


_MEANS = " UNION ALL ".join(
    f"""SELECT CAST({k} AS INTEGER) AS k, count(*) AS users, count(*) FILTER (relevant > 0) AS judged,
    round(avg(precision) FILTER (relevant > 0), 6) AS precision, round(avg(recall), 6) AS recall,
    round(avg(average_precision), 6) AS map, round(avg(ndcg), 6) AS ndcg FROM each{k}"""
    for k in METRIC_CUTOFFS
)
_LAST = METRIC_CUTOFFS[-1]

_FEW = f"""(EXISTS (SELECT 1 FROM core GROUP BY user_id HAVING count(*) < {CORE_BOOKS})
    OR EXISTS (SELECT 1 FROM core GROUP BY book_id HAVING count(*) < {CORE_USERS}))"""

SERVING_ORACLES = {
    "book_search_ranked": f"""WITH query AS (SELECT 0 AS query_id, '{SEARCHED}' AS text), {BM25}
        SELECT ext_book_id, title, author, round(score, 6) AS score FROM scored JOIN doc USING (ext_book_id)""",
    "book_search_top": f"""WITH query AS (SELECT CAST(min(100000 + 7 * p_partkey) AS INTEGER) AS query_id, p_name AS text FROM part GROUP BY p_name),
        {BM25}
        SELECT query_id, CAST(place AS INTEGER) AS rank, ext_book_id, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ext_book_id) AS place FROM scored)
        WHERE place <= {TITLES_FOUND}""",
    "one_user_recs_stored": ORACLES["one_user_recs"],
    "recs_known_stored": ORACLES["fixed_factor_known"],
    "fixed_factor_pruned": f"WITH {FIXED_RECS} SELECT * FROM recs",
    "fixed_factor_pruned_unseen": ORACLES["fixed_factor_unseen_exact"],
    "ranking_metrics_fixed": f"WITH {JUDGED}, {', '.join(_metrics(k) for k in METRIC_CUTOFFS)} {_MEANS}",
    "ranking_metrics_per_user": f"""WITH {JUDGED}, {_metrics(_LAST)}
        SELECT user_id, relevant, hits, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(average_precision, 6) AS average_precision, round(ndcg, 6) AS ndcg FROM each{_LAST}""",
    "active_core": f"""WITH RECURSIVE {RATINGS},
        core AS (
          SELECT 0 AS step, user_id, book_id, rating FROM ratings
          UNION ALL
          SELECT step + 1, user_id, book_id, rating FROM core
          WHERE user_id IN (SELECT user_id FROM core GROUP BY user_id HAVING count(*) >= {CORE_BOOKS})
            AND book_id IN (SELECT book_id FROM core GROUP BY book_id HAVING count(*) >= {CORE_USERS})
            AND {_FEW}),
        last AS (SELECT * FROM core WHERE step = (SELECT max(step) FROM core))
        SELECT user_id, book_id, rating FROM last
        WHERE NOT {_FEW.replace("core", "last")}""",
    "rating_counts_sketched": f"""WITH {RATINGS_RAW}
        SELECT '# of Ratings' AS characteristic, count(rating) AS count, TRUE AS within_error FROM ratings_raw
        UNION ALL SELECT '# of Users', count(DISTINCT user_id), TRUE FROM ratings_raw
        UNION ALL SELECT '# of Books', count(DISTINCT book_id), TRUE FROM ratings_raw""",
    "price_quantiles_sketched": """SELECT CAST(prob AS DOUBLE) AS prob, (SELECT count(l_extendedprice) FROM lineitem) AS prices,
        TRUE AS within_error FROM (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS prob)""",
    "users_table": f"WITH {USERS} SELECT id, username FROM users",
    "rating_preview": f"WITH {RATINGS} SELECT user_id, book_id, rating FROM ratings ORDER BY user_id, book_id LIMIT 20",
    "users_with_rows": f"""WITH {USERS} SELECT id, username FROM users
        UNION ALL SELECT CAST(-n_nationkey - 1 AS INTEGER), n_name FROM nation""",
    "best_point_of": """SELECT CAST(l_linenumber AS INTEGER) AS grid_pos, CAST(l_linenumber * 10 AS INTEGER) AS rank,
        l_linenumber / 20 AS reg, round(stddev_pop(l_quantity), 6) AS rmse, count(*) AS scored
        FROM lineitem GROUP BY l_linenumber ORDER BY rmse, grid_pos LIMIT 1""",
    "ratings_load_refused": ORACLES["ratings_load"],
    "xml_books_variant": ORACLES["xml_books"],
    "xml_shape": "SELECT count(*) AS payloads, TRUE AS drifts FROM part",
    "als_tuned_counts": ORACLES["als_unseen_counts"],
    "als_train_scope_counts": f"""WITH {RATINGS}, {HASHED},
        training AS (SELECT * FROM hashed WHERE bucket < 6000)
        SELECT user_id, least(10, (SELECT count(DISTINCT book_id) FROM training) - count(*)) AS recs, CAST(0 AS BIGINT) AS rated
        FROM ratings WHERE user_id IN (SELECT user_id FROM training) AND book_id IN (SELECT book_id FROM training)
        GROUP BY user_id""",
    "als_subset_counts": f"""WITH {RATINGS}
        SELECT user_id, least(10, (SELECT count(DISTINCT book_id) FROM ratings)) AS recs
        FROM ratings GROUP BY user_id HAVING count(DISTINCT book_id) >= 30""",
    "stream_latest_rating": f"""WITH {NEW_RATINGS}
        SELECT username, ext_book_id, rating, arrival FROM (
          SELECT *, row_number() OVER (PARTITION BY username, ext_book_id ORDER BY ts DESC, arrival DESC, rating DESC) AS place
          FROM incoming JOIN (SELECT event_id AS arrival, ts FROM events) USING (arrival)) WHERE place = 1""",
}
