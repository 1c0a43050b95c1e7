"""Every registered query against the SQL that says what it has to return, or against what must hold of it."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck
from tomewise.plans import derived


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_sql(spark, con, sf_dir, name):
    outcome = compare(spark, con, sf_dir, name)
    assert outcome.startswith("same") and "TYPES" not in outcome, outcome


def recommendations(spark, sf_dir, recs, unseen=True):
    """No pair twice, at most ten a user, of known books, and none that was rated if that is asked."""
    recs = recs.cache()
    users = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("book_id").alias("books"))
    assert users.filter("n > 10 OR n <> books").isEmpty() and not users.isEmpty()
    assert recs.filter("prediction IS NULL OR isnan(prediction)").isEmpty()
    ratings = derived.ratings(spark, sf_dir)
    if unseen:
        assert recs.join(ratings, ["user_id", "book_id"], "left_semi").isEmpty()
    recs.unpersist()


def split_sizes(spark, sf_dir, sizes):
    assert sizes.agg(F.sum("rows")).first()[0] == derived.ratings(spark, sf_dir).count()


def errors(points):
    def check(spark, sf_dir, metrics):
        found = metrics.collect()
        assert len(found) == points and all(r.rmse > 0 and r.scored > 0 for r in found)

    return check


MUST_HOLD = {
    "als_recs_unseen": recommendations,
    "als_recs_filter_after": recommendations,
    "als_tuned": recommendations,
    "als_subset": lambda spark, sf_dir, recs: recommendations(spark, sf_dir, recs, unseen=False),
    "stream_recs": recommendations,
    "stream_foldin_recs": recommendations,
    "random_split_sizes": split_sizes,
    "als_holdout_rmse": errors(1),
    "als_grid": errors(12),
    "als_best_point": errors(1),
}


def some_rows(spark, sf_dir, rows):
    """Queries of the training-data operators; their own tests say what must hold."""
    assert rows.count() > 0


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_queries_without_sql(spark, sf_dir, name):
    assert name in MUST_HOLD or name.startswith("op") or name == "pipeline"
    MUST_HOLD.get(name, some_rows)(spark, sf_dir, queries()[name](spark, sf_dir))


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    recs = entry(spark)
    assert recs.columns == ["user_id", "book_id", "prediction"]
    assert recs.count() == 1500
