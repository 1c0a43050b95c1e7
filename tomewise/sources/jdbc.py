"""Database tables over JDBC, read and written by the executors.

The driver only asks for the bounds of the split column. The JDBC driver jar has to be on the
classpath of every executor, and the database has to be one that all of them can reach.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcTable:
    url: str
    table: str
    properties: dict[str, str] = field(default_factory=dict)

    def bounds_query(self, column: str) -> str:
        return f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {self.table}) bounds"


def read_table(
    spark: SparkSession, source: JdbcTable, split_on: str, partitions: int
) -> DataFrame:
    """The whole table in ``partitions`` parallel reads; filters and columns are pushed down.

    Split on the surrogate key, whose values are spread evenly; a split on ``user_id`` would
    put a heavy user into one task.
    """
    bounds = spark.read.jdbc(
        source.url, source.bounds_query(split_on), properties=source.properties
    ).first()
    if bounds["lo"] is None:
        whole = spark.read.jdbc(source.url, source.table, properties=source.properties)
        if not whole.isEmpty():
            raise ValueError(f"{source.table} has rows but {split_on} is NULL in all of them: split on another column")
        return whole
    return spark.read.jdbc(
        source.url,
        source.table,
        column=split_on,
        lowerBound=int(bounds["lo"]),
        upperBound=int(bounds["hi"]) + 1,
        numPartitions=partitions,
        properties=source.properties,
    )


def write_table(
    df: DataFrame, target: JdbcTable, mode: str = "overwrite", connections: int = 16
) -> None:
    """``overwrite`` empties the table but keeps its definition; ``append`` adds to it.

    ``connections`` bounds what the database has to serve at once; rows are shuffled to that
    many writers, so that computing them is not held to the same number of tasks. A task that is retried
    after its commit was lost inserts its rows again, so give the table a unique key.
    """
    (
        df.repartition(connections)
        .write.option("truncate", True)
        .option("batchsize", 10_000)
        .jdbc(target.url, target.table, mode=mode, properties=target.properties)
    )
