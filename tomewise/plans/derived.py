"""Rating tables derived from the star-schema test tables (see FIXTURES.md)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.operators.quality import latest_per_key

DEFAULT_COVER = "no-cover.png"

# Order of the copies of one user-book pair: the greatest is kept.
NEWEST = [
    "o_orderdate",
    "l_orderkey",
    "l_linenumber",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("l_partkey").cast("int").alias("book_id"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
        *NEWEST,
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating per user and book: (user_id, book_id, rating)."""
    raw = ratings_raw(spark, sf_dir)
    return latest_per_key(raw, ["user_id", "book_id"], NEWEST, ["rating"])


def ext_book_id(book: str):
    return (F.lit(100000) + F.lit(7) * F.col(book)).cast("int")


def isbn10(book: str):
    return F.lpad(F.col(book).cast("string"), 10, "0")


def gr_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("gr_id"),
        ext_book_id("p_partkey").alias("ext_book_id"),
        isbn10("p_partkey").alias("isbn10"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = F.concat(F.lit("https://covers.example/"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        ext_book_id("p_partkey").alias("ext_book_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        (F.lit(1950) + F.col("p_size")).alias("publication_year"),
        F.when(F.col("p_size") % 5 != 0, cover).alias("image_url"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("username")
    )


def new_ratings(events: DataFrame) -> DataFrame:
    """Incoming ratings, from the ``events`` table or a stream of it."""
    user = F.col("user_id")
    book = F.get_json_object("props", "$.k").cast("int")
    customer = F.concat(F.lit("Customer#"), F.lpad(user.cast("string"), 9, "0"))
    reader = F.concat(F.lit("reader_"), user.cast("string"))
    return events.select(
        F.col("event_id").alias("arrival"),
        F.when(user % 3 == 0, reader).otherwise(customer).alias("username"),
        (F.lit(100000) + F.lit(7) * book).alias("ext_book_id"),
        F.lpad(book.cast("string"), 10, "0").alias("isbn10"),
        F.least(F.lit(5), F.floor(F.col("value") / 20) + 1).cast("int").alias("rating"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a fixed factor vector, used for users and for books alike."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
    )
