"""Table schemas, and helpers that apply them.

Two book id spaces exist: ``book_id`` / ``gr_id`` is internal, ``ext_book_id`` is the
external catalog's. User and book ids are 32-bit because ALS accepts nothing wider;
``col_id`` only labels rows, so it is 64-bit.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def struct(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


INT, LONG, DOUBLE, TEXT = IntegerType(), LongType(), DoubleType(), StringType()

# Table names, column names and column order of the rating system.
RATINGS = struct(
    col_id=LONG, user_id=INT, rating=DOUBLE, book_id=INT, username=TEXT, isbn10=TEXT
)
GR_BOOKS = struct(gr_id=INT, ext_book_id=INT, isbn10=TEXT)
NEW_RECS = struct(user_id=INT, book_id=INT, prediction=DOUBLE)
USERS = struct(id=INT, username=TEXT)
TABLES = {"ratings": RATINGS, "gr_books": GR_BOOKS, "new_recs": NEW_RECS, "users": USERS}

# Columns of the analysis-layout rating file and of the book file.
RATINGS_FILE = struct(book_id=INT, user_id=INT, rating=DOUBLE)
BOOKS_FILE = struct(id=INT, title=TEXT)

NEW_RATINGS = struct(arrival=LONG, username=TEXT, ext_book_id=INT, isbn10=TEXT, rating=INT)

MIN_RATING, MAX_RATING = 1, 5


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select and cast ``df`` to exactly ``schema``; a value that does not fit raises."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def rows(spark: SparkSession, data, schema: StructType) -> DataFrame:
    """In-memory rows with a declared schema, never an inferred one."""
    return spark.createDataFrame(data, schema)


def ensure_tables(spark: SparkSession, source: str = "parquet", database: str | None = None) -> None:
    """Create the four tables that are not there yet."""
    for name, schema in TABLES.items():
        full = f"{database}.{name}" if database else name
        if not spark.catalog.tableExists(full):
            spark.catalog.createTable(full, schema=schema, source=source)


# What every stored rating must have.
RATING_NUMBERS = ("col_id", "user_id", "rating", "book_id")
