import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import RegressionEvaluator

from conftest import rows
from tomewise.operators import stats


def ratings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "rating DOUBLE")


def test_histogram_range(spark):
    got = rows(stats.histogram(ratings(spark, [1.0, 5.0, 6.0, 7.0, None])))
    assert got == [(1.0, 1), (2.0, 0), (3.0, 0), (4.0, 0), (5.0, 2)]


def test_mode_takes_the_lowest_of_a_tie(spark):
    assert rows(stats.mean_and_mode(ratings(spark, [2.0, 1.0, 1.0, 2.0, None]))) == [(1.5, 1.0)]


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=40))
def test_describe_is_what_pandas_says(spark, values):
    got = {r.statistic: r.value for r in stats.describe(ratings(spark, values), "rating").collect()}
    for name, value in pd.Series(values).describe().items():
        assert got[name] == pytest.approx(value, abs=2e-6)


def test_describe_of_nothing(spark):
    got = {r.statistic: r.value for r in stats.describe(ratings(spark, [None])).collect()}
    assert got == {"count": 0.0, "mean": None, "std": None, "min": None, "max": None}


def test_describe_of_one_value(spark):
    got = {r.statistic: r.value for r in stats.describe(ratings(spark, [3.0])).collect()}
    assert got["std"] is None and got["25%"] == got["max"] == got["mean"] == 3.0


def test_counts_leave_nulls_out(spark):
    df = spark.createDataFrame(
        [(1, 1, 4.0), (1, 2, None), (None, 2, 3.0)], "user_id INT, book_id INT, rating DOUBLE"
    )
    assert rows(stats.characteristics(df)) == [
        ("# of Books", 2),
        ("# of Ratings", 2),
        ("# of Users", 1),
    ]
    assert rows(stats.characteristics(df, approximate=True)) == rows(stats.characteristics(df))
    assert stats.sparsity(df).first().sparsity_pct == 0.0
    assert stats.sparsity(df.limit(0)).first().sparsity_pct is None


def test_top_rated_order_and_missing_title(spark):
    df = spark.createDataFrame(
        [(1, 5.0), (2, 5.0), (2, 5.0), (3, 5.0), (4, 4.0), (5, 1.0)], "book_id INT, rating DOUBLE"
    )
    titles = spark.createDataFrame([(2, "two"), (1, "one"), (4, "four")], "book_id INT, title STRING")
    got = sorted(map(tuple, stats.top_rated(df, titles, k=3).collect()), key=lambda r: r[0])
    assert got == [(1, "one", 5.0, 1), (2, "two", 5.0, 2), (3, None, 5.0, 1)]


def test_rmse_agrees_with_the_evaluator(spark):
    df = spark.createDataFrame(
        [(1.0, 1.5), (4.0, 3.0), (2.0, 2.25)], "rating DOUBLE, prediction DOUBLE"
    )
    expected = RegressionEvaluator(labelCol="rating", metricName="rmse").evaluate(df)
    assert stats.rmse(df).first().rmse == pytest.approx(expected)


def test_rmse_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "rating DOUBLE, prediction DOUBLE")
    assert rows(stats.rmse(df)) == [(None, 0)]
    df = spark.createDataFrame([(1.0, math.nan)], "rating DOUBLE, prediction DOUBLE")
    assert rows(stats.rmse(df)) == [(None, 0)]
