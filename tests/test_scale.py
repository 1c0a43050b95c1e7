"""Plans and settings that have to hold on a cluster."""

import pytest
from pyspark.sql import functions as F

from tomewise.operators import serve
from tomewise.plans import derived
from tomewise.session import cut, shared_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    names = [
        "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.coalescePartitions.enabled",
        "spark.sql.shuffle.partitions",
    ]
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in zip(names, ["-1", "-1", "20KB", "10KB", "false", "32"]):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_hot_book_is_split_in_the_catalog_join(spark, no_broadcast):
    """A third of all ratings on one book: the join splits its partition and loses nothing."""
    ratings = spark.range(0, 300_000, numPartitions=8).select(
        F.col("id").cast("int").alias("user_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).cast("int").alias("book_id"),
        F.lit(4.0).alias("rating"),
    )
    catalog = spark.range(5000).select(
        F.col("id").cast("int").alias("book_id"),
        F.col("id").cast("int").alias("ext_book_id"),
        F.lit("t").alias("title"),
        F.lit("c").alias("image_url"),
    )
    view = serve.profile_view(ratings, catalog)
    view = view.groupBy("title").agg(F.count("user_id").alias("n"), F.sum("user_id").alias("sum"))
    assert tuple(view.collect()[0]) == ("t", 300_000, sum(range(300_000)))
    assert "skew=true" in plan(view)


def test_scans_read_only_what_is_needed(spark, sf_dir):
    text = plan(derived.ratings(spark, sf_dir).select("user_id"))
    assert "l_shipdate" not in text and "l_suppkey" not in text and "o_totalprice" not in text


def test_filters_reach_the_scan(spark, sf_dir):
    hot = derived.table(spark, sf_dir, "part").filter(F.col("p_type") == "ECONOMY")
    assert "EqualTo(p_type,ECONOMY)" in plan(hot)


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert named is None or named in folder
    written = cut(spark.range(3))
    assert written.count() == 3
    own = folder.rsplit("/", 1)[1]
    assert all(own in path for path in written.inputFiles())
