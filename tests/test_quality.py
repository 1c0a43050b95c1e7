import math

from conftest import rows
from tomewise.operators import quality

PAIR = ["user_id", "book_id"]


def test_duplicate_pair_keeps_the_newest(spark):
    df = spark.createDataFrame(
        [(1, 1, 2.0, 10), (1, 1, 5.0, 11), (1, 2, 3.0, 9)],
        "user_id INT, book_id INT, rating DOUBLE, col_id BIGINT",
    )
    latest = quality.latest_per_key(df, PAIR, ["col_id"], ["rating"])
    assert rows(latest) == [(1, 1, 5.0), (1, 2, 3.0)]
    first = quality.first_per_key(df, PAIR, ["col_id", "rating"], ["rating", "col_id"])
    assert rows(first) == [(1, 1, 2.0, 10), (1, 2, 3.0, 9)]


def test_copies_are_combined_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("1 AS user_id", "2 AS book_id", "4.0D AS rating", "id AS col_id")
    plan = quality.latest_per_key(df, PAIR, ["col_id"], ["rating"])._jdf.queryExecution()
    plan = plan.executedPlan().toString()
    assert "partial_max_by" in plan and "HashAggregate" in plan and "SortAggregate" not in plan


def test_bad_ratings_are_rejected(spark):
    df = spark.createDataFrame(
        [(1, 0.0), (1, 6.0), (1, None), (1, math.nan), (None, 3.0), (1, 3.0)],
        "user_id INT, rating DOUBLE",
    )
    good, bad = quality.screen(df, ["user_id"])
    assert rows(good) == [(1, 3.0)]
    assert bad.count() == 5


def test_integer_ratings_are_screened_too(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (1, None)], "user_id INT, rating INT")
    good, bad = quality.screen(df, ["user_id"])
    assert rows(good) == [(1, 5)] and bad.count() == 2


def test_active_users_count_books_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (2, 1)], "user_id INT, book_id INT")
    assert rows(quality.active_users(df, 2)) == [(1, 2)]
