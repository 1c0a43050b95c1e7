"""Train / validation / test splits."""

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = (0.6, 0.2, 0.2)
_BUCKETS = 10_000


def by_key(df: DataFrame, bucket: Column, buckets: int, weights=WEIGHTS) -> list[DataFrame]:
    """Split by a bucket number ``0..buckets-1`` that belongs to the row."""
    marked = df.withColumn("_bucket", bucket)
    ends = [round(w / sum(weights) * buckets) for w in accumulate(weights)]
    return [
        marked.filter((F.col("_bucket") >= low) & (F.col("_bucket") < high)).drop("_bucket")
        for low, high in zip([0, *ends], ends)
    ]


def by_hash(
    df: DataFrame, seed: int, weights=WEIGHTS, keys=("user_id", "book_id")
) -> list[DataFrame]:
    """Split by a hash of the key, so that neither partitioning nor retries move a row."""
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    bucket = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % _BUCKETS
    return by_key(df, bucket, _BUCKETS, weights)


def at_random(df: DataFrame, seed: int, weights=WEIGHTS) -> list[DataFrame]:
    """Spark's own split; it depends on how ``df`` is partitioned."""
    return df.randomSplit(list(weights), seed)
