"""How good recommendations are as rankings, against ratings that the model did not see.

Per user and cutoff k, over the user's ``k`` best recommendations: precision (relevant ones among k), recall (found ones among
the user's relevant books), average precision (the mean, over the first min(k, relevant) places that could be right, of the
precision at each hit) and NDCG (gains 2^rating - 1 of relevant books, discounted by log2(place + 1), over the best order).
A book is relevant if the user rated it ``least`` or more in the holdout. Users without a relevant book have no
recall, average precision or NDCG, and are left out of all means; users without recommendations score 0.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewise.operators.topk import rank_per_user


def _discounted(place: str):
    return (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col(place) + 1)


def per_user(recs: DataFrame, holdout: DataFrame, k: int, least: float = 4.0) -> DataFrame:
    """(user_id, relevant, hits, precision, recall, average_precision, ndcg) of everybody in ``recs`` or ``holdout``.

    ``recs`` is (user_id, book_id, prediction), ``holdout`` (user_id, book_id, rating), both with one row per pair."""
    relevant = holdout.filter(F.col("rating") >= least).select("user_id", "book_id", F.col("rating").cast("double").alias("gain"))
    ranked = rank_per_user(recs.select("user_id", "book_id", "prediction"), k)
    # At most k rows per user from here on.
    hits = ranked.join(relevant, ["user_id", "book_id"])
    so_far = Window.partitionBy("user_id").orderBy("rank")
    hits = hits.withColumn("found", F.row_number().over(so_far)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(F.col("found") / F.col("rank")).alias("precisions"),
        F.sum(_discounted("rank")).alias("dcg"),
    )
    # The best order is that of the gains; Spark drops all but k rows per user before it shuffles them.
    by_gain = Window.partitionBy("user_id").orderBy(F.desc("gain"), "book_id")
    ideal = relevant.withColumn("place", F.row_number().over(by_gain)).filter(F.col("place") <= k)
    ideal = ideal.groupBy("user_id").agg(F.sum(_discounted("place")).alias("ideal"))
    counts = relevant.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    users = recs.select("user_id").unionByName(holdout.select("user_id")).distinct()
    all_ = users.join(counts, "user_id", "left").join(ideal, "user_id", "left").join(hits, "user_id", "left")
    n, found = F.coalesce("relevant", F.lit(0)), F.coalesce("hits", F.lit(0))
    some = lambda value: F.when(n > 0, F.coalesce(value, F.lit(0.0)))
    return all_.select(
        "user_id",
        n.alias("relevant"),
        found.alias("hits"),
        (found / k).alias("precision"),
        some(found / F.col("relevant")).alias("recall"),
        some(F.col("precisions") / F.least(F.col("relevant"), F.lit(k))).alias("average_precision"),
        some(F.col("dcg") / F.col("ideal")).alias("ndcg"),
    )


def ranking_metrics(recs: DataFrame, holdout: DataFrame, k: int, least: float = 4.0) -> DataFrame:
    """One row (k, users, judged, precision, recall, map, ndcg): means over the ``judged`` users, who have a relevant book."""
    each = per_user(recs, holdout, k, least)
    judged = F.col("relevant") > 0
    return each.agg(
        F.lit(k).alias("k"),
        F.count(F.lit(1)).alias("users"),
        F.count_if(judged).alias("judged"),
        F.avg(F.when(judged, F.col("precision"))).alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("average_precision").alias("map"),
        F.avg("ndcg").alias("ndcg"),
    )
