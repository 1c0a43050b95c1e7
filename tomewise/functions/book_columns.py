"""Column expressions for book data."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cover(image_url: str, default: str) -> Column:
    """The cover, or a default where there is none (missing or empty)."""
    return F.coalesce(F.nullif(F.col(image_url), F.lit("")), F.lit(default))


def rateable(book_id: str) -> Column:
    """Only a book with an id can be rated."""
    return F.col(book_id).isNotNull()


def title_matches(column: str, text: str) -> Column:
    return F.lower(column).contains(text.lower())


def lookup_url(base: str, text: str) -> Column:
    """Address of a lookup by free text; nothing is fetched."""
    return F.concat(F.lit(base), F.url_encode(F.col(text)))


# Fixed value: what stands before an author's name.
BY = "By: "


def byline(author: str) -> Column:
    """``By: name``; NULL, and so no line, without an author."""
    return F.concat(F.lit(BY), F.col(author))
