"""What the plans of stored tables read and move."""

import uuid

from pyspark.sql import functions as F

from conftest import rows
from tomewise.sources.bucketed import buckets_for, join_buckets, open_bucketed, write_bucketed

RECS = "user_id INT, book_id INT, prediction DOUBLE"


def name():
    return f"t_{uuid.uuid4().hex}"


def recs(spark, n=400):
    return spark.range(n).select((F.col("id") % 40).cast("int").alias("user_id"), F.col("id").cast("int").alias("book_id"), F.rand(1).alias("prediction"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_one_user_is_one_bucket(spark, tmp_path):
    table = write_bucketed(recs(spark), name(), f"{tmp_path}/recs", "user_id", 8, ["user_id", "book_id"])
    one = table.filter(F.col("user_id") == 7)
    assert "SelectedBucketsCount: 1 out of 8" in formatted(one)
    assert rows(one) == rows(recs(spark).filter("user_id = 7"))
    again = open_bucketed(spark, name(), f"{tmp_path}/recs", RECS, "user_id", 8, ["user_id", "book_id"])
    assert "SelectedBucketsCount: 1 out of 8" in formatted(again.filter("user_id = 7"))
    assert rows(again) == rows(recs(spark))


def test_tables_bucketed_alike_join_without_an_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        order = ["user_id", "book_id"]
        rated = recs(spark).filter("book_id % 3 = 0").select(*order, F.lit(5.0).alias("rating"))
        left = write_bucketed(recs(spark), name(), f"{tmp_path}/l", "user_id", 8, order)
        right = write_bucketed(rated, name(), f"{tmp_path}/r", "user_id", 8, order)
        joined = join_buckets(left, right, order)
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        assert rows(joined) == rows(recs(spark).join(rated, order, "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_buckets_are_powers_of_two():
    assert [buckets_for(n) for n in (0, 1, 32_000_000, 32_000_001, 4_000_000_000)] == [8, 8, 8, 16, 1024]
