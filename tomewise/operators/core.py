"""The part of the ratings in which everybody is active: every user has enough books and every book enough users.

Dropping a user may leave a book with too few users, and the other way round, so both are peeled off until nothing more
goes; what is left is the largest such part, whatever the order. It may be empty.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.session import cut, delete, fresh_dir


def _few(pairs: DataFrame, key: str, least: int) -> DataFrame:
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least).select(key)


def active_core(ratings: DataFrame, user_books: int, book_users: int) -> DataFrame:
    """Rows of ``ratings`` whose user has rated at least ``user_books`` different books of the core and whose book was rated
    by at least ``book_users`` users of it. Rows without a user or book are never in it; rows that repeat a pair
    count as one for the degrees and stay together.

    Each round drops users, then the books that this leaves with too few, so it takes two links of a chain of users and books
    that lose their footing one after the other. It writes down the pairs that are left and deletes those of the round
    before. ``ratings`` are read twice.
    """
    spark = ratings.sparkSession
    ratings = ratings.filter("user_id IS NOT NULL AND book_id IS NOT NULL")
    pairs, before = cut(ratings.select("user_id", "book_id").distinct()), None
    while True:
        users = cut(_few(pairs, "user_id", user_books))
        # The books of a round have been counted without its users, so they only fall short if users go.
        if before and users.isEmpty():
            break
        left = pairs.join(users, "user_id", "left_anti")
        books = cut(_few(left, "book_id", book_users))
        if books.isEmpty():
            pairs = left
            break
        path = fresh_dir(spark, "core")
        left.join(books, "book_id", "left_anti").write.parquet(path)
        pairs = spark.read.schema(pairs.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return ratings.join(pairs, ["user_id", "book_id"], "left_semi")
