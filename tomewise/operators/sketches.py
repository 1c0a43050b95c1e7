"""Distinct counts and quantiles that can be added up: a sketch per day or batch, merged without the rows.

Distinct counts are HyperLogLog sketches of 2^``LOG_K`` registers, whose relative standard error is about
1.04 / sqrt(2^LOG_K), so below 3 percent at three standard errors for the default. Quantiles are KLL sketches, whose rank
error is below 1.7 percent at ``KLL_K`` = 200 with 99 percent confidence. A sketch has a bounded size, so the
stored table grows with the number of batches, not of ratings.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K, KLL_K = 14, 800
COUNT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LOG_K / 2), 0.005


def sketch_counts(ratings: DataFrame, batch: Column, users: str = "user_id", books: str = "book_id") -> DataFrame:
    """(batch, ratings, users, books): how many ratings each batch has, and sketches of its users and books."""
    return ratings.groupBy(batch.alias("batch")).agg(
        F.count("rating").alias("ratings"),
        F.hll_sketch_agg(users, LOG_K).alias("users"),
        F.hll_sketch_agg(books, LOG_K).alias("books"),
    )


def merge_counts(sketches: DataFrame, *by: str) -> DataFrame:
    """The same of several batches together: of all, or per value of other columns. Can be merged again."""
    merged = sketches.groupBy(*by) if by else sketches
    return merged.agg(
        F.sum("ratings").alias("ratings"), F.hll_union_agg("users").alias("users"), F.hll_union_agg("books").alias("books")
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """Sketches as numbers; ratings are exact."""
    return sketches.withColumns({name: F.hll_sketch_estimate(name) for name in ("users", "books")})


def sketch_quantiles(df: DataFrame, column: str, batch: Column) -> DataFrame:
    """(batch, sketch) of the values of each batch; NULL and NaN are no values."""
    known = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    return known.groupBy(batch.alias("batch")).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(KLL_K)).alias("sketch"))


def merge_quantiles(sketches: DataFrame, *by: str) -> DataFrame:
    merged = sketches.groupBy(*by) if by else sketches
    return merged.agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles_of(sketches: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """(prob, value) for every sketch."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    values = F.kll_sketch_get_quantile_double("sketch", wanted)
    pairs = F.arrays_zip(wanted.alias("prob"), values.alias("value"))
    others = [c for c in sketches.columns if c != "sketch"]
    told = sketches.select(*others, F.explode(pairs).alias("told"))
    return told.select(*others, F.col("told.prob").alias("prob"), F.col("told.value").alias("value"))
