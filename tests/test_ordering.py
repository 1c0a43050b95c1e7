import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from tomewise.operators.ordering import in_ranges, number_rows, running_total


@pytest.fixture(autouse=True, scope="module")
def many_ranges(spark):
    """Keep the ranges that AQE would merge, small as they are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


few = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_numbers_are_gap_free_over_many_ranges(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = rows(number_rows(df, ["k"], "n", 101))
    assert got == [(k, k + 101) for k in range(5000)]
    ranged = in_ranges(df, ["k"])
    assert ranged.select("_range").distinct().count() > 1


def test_one_order_value_for_a_third_of_the_rows(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("at"), "id"
    )
    expected = sorted((5 if i % 3 == 0 else i, i) for i in range(900))
    got = sorted(map(tuple, number_rows(df, ["at", "id"], "n").collect()), key=lambda r: r[2])
    assert got == [(*pair, n) for n, pair in enumerate(expected, 1)]


def test_no_rows(spark):
    assert number_rows(spark.range(0), ["id"], "n").count() == 0


@few
@given(st.sets(st.integers(-1000, 1000), min_size=1), st.data())
def test_running_total(spark, keys, data):
    weights = {k: data.draw(st.integers(0, 50)) for k in keys}
    df = spark.createDataFrame(sorted(weights.items()), "k INT, w BIGINT")
    total, expected = 0, []
    for k in sorted(weights):
        total += weights[k]
        expected.append((k, weights[k], total))
    ranged = in_ranges(df, ["k"])
    assert rows(running_total(ranged, ["k"], "w", "upto")) == expected
    if total:
        at = data.draw(st.integers(0, total - 1))
        near = rows(running_total(ranged, ["k"], "w", "upto", around=[at]))
        assert set(near) <= set(expected)
        assert any(upto - w <= at < upto for _, w, upto in near)


def test_equal_rows_do_not_make_one_large_range(spark):
    df = spark.range(200_000, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("at")
    )
    numbered = number_rows(df, ["at"], "n", repeats=True)
    path = numbered.inputFiles()[0].rsplit("/", 1)[0]
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_range").count().collect()]
    assert max(sizes) <= 2 * 200_000 / len(sizes)
    ends = numbered.filter("at = 5").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    # Half of the rows, and the odd id 5.
    assert ends[1] - ends[0] + 1 == ends[2] == 100_001
    assert numbered.agg(F.countDistinct("n"), F.max("n")).first()[:] == (200_000, 200_000)
