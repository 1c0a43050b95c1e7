"""Recommendations of a fitted model, and the removal of books already rated."""

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.operators.topk import best_items

PAIR = ["user_id", "book_id"]


def flatten(nested: DataFrame) -> DataFrame:
    """``recommendations array<struct<book_id, rating>>`` to one row per recommendation."""
    return nested.select("user_id", F.explode("recommendations").alias("rec")).select(
        "user_id",
        F.col("rec.book_id").alias("book_id"),
        F.col("rec.rating").cast("double").alias("prediction"),
    )


def nest(recs: DataFrame) -> DataFrame:
    """The inverse of :func:`flatten`; each user's list is as long as the top-n was."""
    best_first = F.struct((-F.col("prediction")).alias("cost"), "book_id", "prediction")
    listed = recs.groupBy("user_id").agg(F.array_sort(F.collect_list(best_first)).alias("all"))
    entry = lambda r: F.struct(r.book_id.alias("book_id"), r.prediction.alias("rating"))
    return listed.select("user_id", F.transform("all", entry).alias("recommendations"))


def drop_seen(recs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Recommendations of books the user has not rated."""
    return recs.join(ratings.select(*PAIR).distinct(), PAIR, "left_anti")


def with_known_rating(recs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Recommendations with the user's own rating, NULL where there is none.

    ``ratings`` has one row per user and book; copies would repeat the recommendation.
    """
    return recs.join(ratings.select(*PAIR, "rating"), PAIR, "left")


def drop_seen_by_null(recs: DataFrame, ratings: DataFrame) -> DataFrame:
    """:func:`drop_seen` spelled as outer join and NULL test; a NULL rating counts as unseen."""
    return with_known_rating(recs, ratings).filter(F.col("rating").isNull()).drop("rating")


def top_n(model: ALSModel, n: int = 10) -> DataFrame:
    """The ``n`` best books per user, seen ones included.

    The rows of ``recommendForAllUsers``, by products of large blocks: that moves and scores a block of 4096 at a time.
    """
    return best_items(model.userFactors, model.itemFactors, n).select(*PAIR, "prediction")


def top_n_for(model: ALSModel, users: DataFrame, n: int = 10) -> DataFrame:
    """:func:`top_n` for some users only; users the model does not know get none."""
    asked = users.select(F.col("user_id").alias("id"))
    return best_items(model.userFactors.join(asked, "id", "left_semi"), model.itemFactors, n).select(*PAIR, "prediction")


def unseen_top_n(model: ALSModel, ratings: DataFrame, n: int = 10) -> DataFrame:
    """Exactly ``n`` unseen books per user, fewer only if fewer are left."""
    best = best_items(model.userFactors, model.itemFactors, n, seen=ratings)
    return best.select(*PAIR, "prediction")


def newer_users(recs: DataFrame, cutoff: int | None) -> DataFrame:
    """Recommendations of users that came after the seed data; all of them by default."""
    return recs if cutoff is None else recs.filter(F.col("user_id") > cutoff)
