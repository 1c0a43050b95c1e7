"""Screening, deduplication and key checks on rating data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.schemas import MAX_RATING, MIN_RATING


def is_valid_rating(rating: str = "rating"):
    value = F.col(rating)
    return F.coalesce(value.between(MIN_RATING, MAX_RATING), F.lit(False)) & ~F.isnan(
        value.cast("double")
    )


def screen(df: DataFrame, required: list[str], rating: str = "rating"):
    """Split into rows that may be used and rows that must be rejected."""
    ok = is_valid_rating(rating)
    for name in required:
        ok = ok & F.col(name).isNotNull()
    return df.filter(ok), df.filter(~ok)


def _one_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str], pick):
    """One aggregate rather than ``row_number``: it combines on the map side, so a pair that was
    rated millions of times reaches the reducer as one row per map task. A single column is
    passed bare, since fixed-width buffers are aggregated by hash and structs by sorting. A
    single order column must not hold NULLs.
    """
    bare = lambda names: F.col(names[0]) if len(names) == 1 else F.struct(*names)
    kept = pick(bare(keep), bare(order)).alias("_kept")
    columns = ["_kept"] if len(keep) == 1 else [f"_kept.{name}" for name in keep]
    return df.groupBy(*keys).agg(kept).select(*keys, *columns).toDF(*keys, *keep)


def latest_per_key(
    df: DataFrame, keys: list[str], newest_by: list[str], keep: list[str]
) -> DataFrame:
    """``keep`` of the row with the greatest ``newest_by`` of every key."""
    return _one_per_key(df, keys, newest_by, keep, F.max_by)


def first_per_key(
    df: DataFrame, keys: list[str], oldest_by: list[str], keep: list[str]
) -> DataFrame:
    """``keep`` of the row with the least ``oldest_by`` of every key."""
    return _one_per_key(df, keys, oldest_by, keep, F.min_by)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().filter("count > 1")


def active_users(ratings: DataFrame, min_books: int) -> DataFrame:
    """Users who rated at least ``min_books`` different books."""
    return (
        ratings.groupBy("user_id")
        .agg(F.countDistinct("book_id").alias("books"))
        .filter(F.col("books") >= min_books)
    )


def union_ratings(base: DataFrame, new: DataFrame) -> DataFrame:
    return base.unionByName(new)
