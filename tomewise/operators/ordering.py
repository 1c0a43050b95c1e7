"""Global order without a single-task window.

A window that has no partition key pulls every row into one task. Here rows are range
partitioned by the order columns, counted inside each range, and shifted by the total of
the ranges before it. The ranges are cut to the shared folder before they are counted, so
that a retried task cannot move a row from one range to another between the two passes.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewise.session import cut

# monotonically_increasing_id() keeps the partition in the bits above these.
_ROW_BITS = 33


def _with_before(totals: DataFrame) -> DataFrame:
    """Add the total of the ranges before each range; there is one row per partition."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))


def number_rows(
    df: DataFrame, order_by: list[str], name: str, start: int = 1, repeats: bool = False
) -> DataFrame:
    """Add gap-free numbers ``start, start+1, ...`` in the order of ``order_by``.

    ``order_by`` should identify a row; rows equal in all of it are numbered arbitrarily. With ``repeats``
    there may be any number of equal rows: their place in a written table splits them among ranges.
    """
    order = order_by
    if repeats:
        df = cut(df).withColumn("_place", F.monotonically_increasing_id())
        order = [*order_by, "_place"]
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop(*order[len(order_by) :])
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", _ROW_BITS).cast("int"))
    )
    totals = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_total"))
    in_range = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(_with_before(totals)), "_range")
        .withColumn(name, F.col("_before") + in_range + F.lit(start))
        .drop("_at", "_range", "_before", "_total")
    )


def in_ranges(df: DataFrame, order_by: list[str]) -> DataFrame:
    """``df`` written down with the range each row belongs to, for :func:`running_total`."""
    return cut(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()))


def running_total(
    ranged: DataFrame,
    order_by: list[str],
    weight: str,
    name: str,
    around: list[int] | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over all rows up to and including this one.

    With ``around`` only the ranges are kept in which the total passes one of these values, so
    that looking a few values up does not sort all the others.
    """
    totals = _with_before(ranged.groupBy("_range").agg(F.sum(weight).alias("_total")))
    if around is not None:
        passes = lambda at: (at >= F.col("_before")) & (at < F.col("_before") + F.col("_total"))
        places = F.array(*[F.lit(at).cast("long") for at in around])
        totals = totals.filter(F.exists(places, passes))
    inside = (
        Window.partitionBy("_range")
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.join(F.broadcast(totals), "_range")
        .withColumn(name, F.col("_before") + F.sum(weight).over(inside))
        .drop("_range", "_before", "_total")
    )
