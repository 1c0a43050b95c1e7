"""Descriptive statistics of rating data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.operators.ordering import in_ranges, running_total

QUARTILES = (0.25, 0.5, 0.75)


def _totals(ratings: DataFrame, approximate: bool) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return ratings.agg(
        F.count("rating").alias("ratings"),
        distinct("user_id").alias("users"),
        distinct("book_id").alias("books"),
    )


# The labels of the three rows, and the edges of the rating histogram.
LABELS = ("# of Ratings", "# of Users", "# of Books")
EDGES = (1, 2, 3, 4, 5, 6)


def characteristics(ratings: DataFrame, approximate: bool = False) -> DataFrame:
    """Numbers of ratings, users and books as three labelled rows."""
    return _totals(ratings, approximate).select(
        F.expr(
            "stack(3, '{}', ratings, '{}', users, '{}', books) AS (characteristic, count)".format(*LABELS)
        )
    )


def sparsity(ratings: DataFrame, approximate: bool = False) -> DataFrame:
    """Share of user-book pairs without a rating, in percent."""
    pairs = F.col("users").cast("double") * F.col("books")
    share = (F.lit(1.0) - F.col("ratings") / F.nullif(pairs, F.lit(0.0))) * 100
    return _totals(ratings, approximate).select(
        "ratings", "users", "books", F.round(share, 2).alias("sparsity_pct")
    )


def mean_and_mode(ratings: DataFrame) -> DataFrame:
    """Average rating and the most frequent one; the lowest of several most frequent."""
    per_value = ratings.filter("rating IS NOT NULL").groupBy("rating").count()
    return per_value.agg(
        (F.sum(F.col("rating") * F.col("count")) / F.sum("count")).alias("mean_rating"),
        F.max_by("rating", F.struct(F.col("count"), -F.col("rating"))).alias("modal_rating"),
    )


def histogram(ratings: DataFrame, edges=EDGES, column: str = "rating") -> DataFrame:
    """Counts between consecutive edges; the last bin includes its upper edge.

    One conditional count per bin in a single pass: each task sends one row, and a bin
    without values is still reported.
    """
    value, last = F.col(column), len(edges) - 2
    counts = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        below = value <= high if i == last else value < high
        counts.append(F.count_if((value >= low) & below).alias(f"b{i}"))
    pairs = ", ".join(f"CAST({edge} AS DOUBLE), b{i}" for i, edge in enumerate(edges[:-1]))
    return ratings.agg(*counts).select(
        F.expr(f"stack({len(counts)}, {pairs}) AS (bin, count)")
    )


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    """(v, n): how often each value occurs, in ranges of the value.

    Equal values are counted before anything is ordered, so that a frequent value costs no more
    than a rare one.
    """
    counted = (
        df.filter(F.col(column).isNotNull())
        .select(F.col(column).cast("double").alias("v"))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return in_ranges(counted, ["v"])


def _quantiles(counts: DataFrame, n: int, probs) -> DataFrame:
    places = []
    for p in probs:
        at = p * (n - 1)
        places += [(float(p), int(at), 1 - at % 1), (float(p), int(at) + 1, at % 1)]
    # At most two places per probability: a constant that fits into an expression.
    places = [place for place in places if place[2] > 0]
    fields = ("prob", "place", "share")
    wanted = F.array(
        *[F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, place)]) for place in places]
    )
    here = lambda w: (w.place >= F.col("upto") - F.col("n")) & (w.place < F.col("upto"))
    around = [place for _, place, _ in places]
    return (
        running_total(counts, ["v"], "n", "upto", around)
        .select("v", F.explode(F.filter(wanted, here)).alias("hit"))
        .groupBy("hit.prob")
        .agg(F.sum(F.col("v") * F.col("hit.share")).alias("value"))
    )


def quantiles(df: DataFrame, column: str, probs=QUARTILES) -> DataFrame:
    """Exact linearly interpolated quantiles as ``(prob, value)`` rows; none without values."""
    counts = _value_counts(df, column)
    return _quantiles(counts, counts.agg(F.sum("n")).first()[0] or 0, probs)


def describe(df: DataFrame, column: str = "rating", decimals: int = 6) -> DataFrame:
    """count, mean, std, min, quartiles and max as ``(statistic, value)`` rows.

    ``df`` is read once; everything follows from the counts of its values. Without any values
    the count is 0 and there are no quartiles.
    """
    counts = _value_counts(df, column)
    v, n = F.col("v"), F.col("n")
    count, mean = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.sum(v * n) / F.sum(n)).first()
    off = v - F.lit(mean)
    moments = counts.agg(
        F.lit(float(count)).alias("count"),
        F.lit(mean).cast("double").alias("mean"),
        F.sqrt(F.sum(n * off * off) / F.nullif(F.lit(count - 1), F.lit(0))).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    long = moments.unpivot([], moments.columns, "statistic", "value")
    percent = F.format_string("%d%%", F.round(F.col("prob") * 100).cast("int"))
    quarters = _quantiles(counts, count, QUARTILES).select(percent.alias("statistic"), "value")
    return long.unionByName(quarters).withColumn("value", F.round("value", decimals))


def top_rated(
    ratings: DataFrame, titles: DataFrame, k: int = 5, min_ratings: int = 1
) -> DataFrame:
    """The ``k`` books with the best average, with their titles.

    ``titles`` has ``book_id`` and ``title``. Only ``k`` rows meet the catalog.
    """
    best = (
        ratings.groupBy("book_id")
        .agg(F.avg("rating").alias("avg_rating"), F.count("rating").alias("ratings"))
        .filter(F.col("ratings") >= min_ratings)
        .orderBy(F.desc("avg_rating"), F.desc("ratings"), "book_id")
        .limit(k)
    )
    # A right outer join cannot broadcast its right side, hence the two steps.
    found = titles.join(F.broadcast(best.select("book_id")), "book_id", "left_semi")
    return best.join(found, "book_id", "left").select(
        "book_id", "title", "avg_rating", "ratings"
    )


def rmse(predictions: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    """Root mean squared error as one row; NULL when there is nothing to score."""
    error = F.col(prediction).cast("double") - F.col(label)
    return predictions.filter(~F.isnan(prediction)).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.count(error).alias("scored")
    )
