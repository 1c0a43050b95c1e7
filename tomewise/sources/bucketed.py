"""Tables stored by user: bucketed and sorted, so that one user is one bucket and equal buckets join where they are."""

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BUCKET, LEAST_BUCKETS = 4_000_000, 8


def buckets_for(n_rows: int) -> int:
    """A power of two, so that tables of different sizes can still be joined bucket by bucket."""
    wanted = max(LEAST_BUCKETS, -(-n_rows // ROWS_PER_BUCKET))
    return 1 << (wanted - 1).bit_length()


# What a session needs that reads such tables: one bucket for one key even where nothing is joined, and a join by several
# columns of which one is the buckets'.
BUCKETED = {
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def use_buckets(spark: SparkSession) -> None:
    for key, value in BUCKETED.items():
        spark.conf.set(key, value)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int, sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to ``path`` as the table ``name``, one file per bucket of ``key``."""
    dealt = df.repartition(buckets, key)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(*(sort_by or [key]))
    writer.option("path", path).mode("overwrite").saveAsTable(name)
    use_buckets(df.sparkSession)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int, sort_by: list[str] | None = None) -> DataFrame:
    """What another application wrote with :func:`write_bucketed`, under a name of this one."""
    order = ", ".join(sort_by or [key])
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    use_buckets(spark)
    return spark.table(name)


def join_buckets(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join of two tables that are bucketed alike by one of ``on``: sorted and merged where they lie, without an exchange."""
    use_buckets(left.sparkSession)
    return left.join(right.hint("merge"), on, how)
