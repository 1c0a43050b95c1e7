"""Profile, recommendation, search and detail views, for any number of users at once.

The catalog is assembled first, so that the large rating or recommendation side is shuffled
at most once. No side is broadcast by hint: Spark does it where it measured the side small.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.functions.book_columns import cover, rateable, title_matches


def catalog(gr_books: DataFrame, books: DataFrame, default_cover: str) -> DataFrame:
    """Internal id to external id and metadata; a book without metadata keeps its row."""
    known = gr_books.select(F.col("gr_id").alias("book_id"), "ext_book_id")
    return known.join(books, "ext_book_id", "left").select(
        "book_id", "ext_book_id", "title", cover("image_url", default_cover).alias("image_url")
    )


def profile_view(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each user's rated books. A book missing from the lookup has a NULL external id."""
    return ratings.join(catalog, "book_id", "left").select(
        "user_id", "ext_book_id", "title", "image_url", "rating"
    )


def lookup_misses(ratings: DataFrame, gr_books: DataFrame) -> DataFrame:
    """How many ratings name a book that the lookup lacks."""
    lost = ratings.join(gr_books, ratings.book_id == gr_books.gr_id, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("misses"))


def recs_view(
    recs: DataFrame, ratings: DataFrame, catalog: DataFrame, users: DataFrame | None = None
) -> DataFrame:
    """Recommendations of books that anybody has rated, with metadata.

    ``users`` (user_id) restricts the view to those users.
    """
    if users is not None:
        recs = recs.join(users.select("user_id").distinct(), "user_id", "left_semi")
    rated = ratings.select("book_id").distinct()
    served = recs.join(rated, "book_id", "left_semi").join(catalog, "book_id", "left")
    return served.select("user_id", "ext_book_id", "title", "image_url", "prediction")


def recs_of_user(recs: DataFrame, user_id: int) -> DataFrame:
    return recs.filter(F.col("user_id") == user_id)


def search(books: DataFrame, title: str, author: str | None = None) -> DataFrame:
    """Books whose title contains the text, whatever the case, in order of title and id."""
    hits = books.filter(title_matches("title", title))
    if author:
        hits = hits.filter(title_matches("author", author))
    return hits.select("ext_book_id", "title", "author", "image_url").orderBy(
        "title", "ext_book_id"
    )


def details(books: DataFrame, default_cover: str, ext_book_id: int | None = None) -> DataFrame:
    """The detail view of one book, or of all of them."""
    if ext_book_id is not None:
        books = books.filter(F.col("ext_book_id") == ext_book_id)
    return books.select(
        "ext_book_id",
        "title",
        "author",
        "publication_year",
        cover("image_url", default_cover).alias("image_url"),
        rateable("ext_book_id").alias("rateable"),
    )
