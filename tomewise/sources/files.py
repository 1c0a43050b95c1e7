"""CSV sources."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tomewise.schemas import BOOKS_FILE, RATING_NUMBERS, RATINGS, RATINGS_FILE, conform
from tomewise.session import cut

CORRUPT = "_corrupt"


def _reader(spark: SparkSession, line_breaks: bool = False) -> DataFrameReader:
    """A quote inside a quoted value is doubled, as most programs write it. With ``line_breaks`` quoted
    values may hold them; such files are not split among tasks."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", line_breaks)


def read_by_name(
    spark: SparkSession, path: str, schema: StructType, line_breaks: bool = False
) -> DataFrame:
    """The named columns of a CSV with a header, in any order, among any others.

    Everything is read as text and cast: types are declared, and nothing is inferred from
    the data except the header line. A value that does not fit raises.
    """
    return conform(_reader(spark, line_breaks).csv(path), schema)


def rating_file(spark: SparkSession, path: str) -> DataFrame:
    return read_by_name(spark, path, RATINGS_FILE)


def book_file(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    return read_by_name(spark, path, BOOKS_FILE, line_breaks)


def lookup_file(spark: SparkSession, path: str) -> DataFrame:
    """The id lookup. ISBNs stay text: as numbers they would lose their leading zeros.

    ``position`` orders the rows as they stand in the file, for "first row wins".
    """
    raw = _reader(spark).csv(path)
    # Rows are sorted by their position: with the number of the file they are half as wide as with its path.
    paths = raw.select(F.col("_metadata.file_path").alias("_path")).distinct()
    numbers = paths.agg(F.sort_array(F.collect_list("_path")).alias("all")).select(F.posexplode("all").alias("_file", "_path"))
    rows = raw.select(
        F.col("r_index").cast("int").alias("gr_id"),
        F.col("book_id").cast("int").alias("ext_book_id"),
        F.col("isbn").alias("isbn10"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # One row per file.
    numbered = rows.join(F.broadcast(numbers), "_path")
    return numbered.select("gr_id", "ext_book_id", "isbn10", F.struct("_file", "_start", "_row").alias("position"))


def ratings_by_position(spark: SparkSession, path: str) -> DataFrame:
    """The six rating columns by position, below a header.

    Any bad row fails a load of all columns, which is what appending them to a table is.
    """
    return (
        _reader(spark)
        .schema(RATINGS)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def ratings_with_quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Like :func:`ratings_by_position`, but bad rows are set aside with their text."""
    read = (
        _reader(spark)
        .schema(StructType([*RATINGS, StructField(CORRUPT, StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    # Spark only notices a bad value in a column that is read, so read all of them once.
    read = cut(read)
    # An empty number is no number either.
    empty = reduce(or_, [F.col(name).isNull() for name in RATING_NUMBERS])
    text = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*RATINGS.fieldNames())))
    broken = F.col(CORRUPT).isNotNull() | empty
    return read.filter(~broken).drop(CORRUPT), read.filter(broken).withColumn(CORRUPT, text)
