"""Ranking metrics against a loop, k-cores against peeling by hand, sketches against exact numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tomewise.operators import core, sketches
from tomewise.operators.core import active_core
from tomewise.operators.ranking import per_user, ranking_metrics
from tomewise.plans import queries_serving

RECS, RATINGS = "user_id INT, book_id INT, prediction DOUBLE", "user_id INT, book_id INT, rating DOUBLE"


def brute(recs, holdout, k, least):
    out = []
    for u in sorted({r[0] for r in recs} | {r[0] for r in holdout}):
        best = [b for _, b, p in sorted((r for r in recs if r[0] == u), key=lambda r: (-r[2], r[1]))][:k]
        good = {b: g for x, b, g in holdout if x == u and g >= least}
        hits = [i for i, b in enumerate(best, 1) if b in good]
        gain = lambda g, place: (2**g - 1) / math.log2(place + 1)
        row = [u, len(good), len(hits), len(hits) / k, None, None, None]
        if good:
            ideal = sum(gain(g, i) for i, g in enumerate(sorted(good.values(), reverse=True)[:k], 1))
            dcg = sum(gain(good[best[i - 1]], i) for i in hits)
            precisions = sum(n / i for n, i in enumerate(hits, 1))
            row[4:] = [len(hits) / len(good), precisions / min(len(good), k), dcg / ideal]
        out.append(tuple(row))
    return out


def close(a, b):
    return len(a) == len(b) and all(x is y is None or x == y or abs(x - y) < 1e-12 for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("k", [1, 3, 10])
def test_metrics_per_user_are_those_of_a_loop(spark, k):
    rng = random.Random(k)
    recs = [(u, b, rng.choice([0.1, 0.5, rng.random()])) for u in range(12) for b in rng.sample(range(30), rng.randrange(1, 9))]
    holdout = [(u, b, float(rng.randrange(1, 6))) for u in range(4, 16) for b in rng.sample(range(30), rng.randrange(9))]
    got = rows(per_user(spark.createDataFrame(recs, RECS), spark.createDataFrame(holdout, RATINGS), k))
    want = brute(recs, holdout, k, 4.0)
    assert close(got, want)
    (mean,) = rows(ranking_metrics(spark.createDataFrame(recs, RECS), spark.createDataFrame(holdout, RATINGS), k))
    judged = [r for r in want if r[1]]
    assert mean[:3] == (k, len(want), len(judged))
    assert close([mean[3:]], [tuple(sum(r[i] for r in judged) / len(judged) for i in range(3, 7))])


def test_nobody_to_judge(spark):
    none = spark.createDataFrame([], RATINGS)
    one = spark.createDataFrame([(1, 2, 0.5)], RECS)
    assert rows(ranking_metrics(one, none, 5)) == [(5, 1, 0, None, None, None, None)]
    assert rows(per_user(one, spark.createDataFrame([(1, 2, 3.0)], RATINGS), 5)) == [(1, 0, 0, 0.0, None, None, None)]


def test_a_chain_loses_its_footing_one_by_one(spark):
    """A path in which each vertex is held by the next: ten rounds from either end; and a square that stays."""
    path = [(i, i, 1.0) for i in range(10)] + [(i, i + 1, 1.0) for i in range(10)]
    square = [(u, b, 2.0) for u in (100, 101) for b in (200, 201)]
    odd = [(None, 200, 3.0), (100, None, 3.0), (100, 200, 2.0)]
    got = rows(active_core(spark.createDataFrame([*path, *square, *odd], RATINGS), 2, 2))
    assert got == sorted([*square, (100, 200, 2.0)])
    assert active_core(spark.createDataFrame(path, RATINGS), 2, 2).collect() == []
    assert active_core(spark.createDataFrame([], RATINGS), 1, 1).collect() == []


def test_a_round_takes_two_links_of_a_chain(spark, monkeypatch):
    """A path of 20 links is eaten from its two loose ends, a user and the book it holds in each round."""
    written, fresh = [], core.fresh_dir
    monkeypatch.setattr(core, "fresh_dir", lambda spark, name: written.append(name) or fresh(spark, name))
    path = [(i, i, 1.0) for i in range(10)] + [(i, i + 1, 1.0) for i in range(10)]
    square = [(u, b, 2.0) for u in (100, 101) for b in (200, 201)]
    assert rows(active_core(spark.createDataFrame([*path, *square], RATINGS), 2, 2)) == square
    # Both ends are books here; dropping both kinds at once wrote the pairs ten times.
    assert len(written) <= 6


def test_users_go_although_no_book_falls_short(spark):
    few = [(1, 10, 1.0), (2, 10, 1.0), (2, 11, 1.0), (3, 10, 1.0), (3, 11, 1.0)]
    assert rows(active_core(spark.createDataFrame(few, RATINGS), 2, 2)) == few[1:]


def test_the_test_part_is_split_off_once(spark, sf_dir):
    """The split hashes every rating; the metrics read its outcome several times."""
    _, test = queries_serving._judged(spark, sf_dir)
    assert "md5" not in test._jdf.queryExecution().executedPlan().toString()


def test_merged_sketches_are_those_of_one_pass(spark):
    ratings = spark.range(30_000).select(
        (F.col("id") % 7).cast("int").alias("day"), (F.col("id") % 4001).cast("int").alias("user_id"),
        (F.col("id") % 997).cast("int").alias("book_id"), F.lit(1.0).alias("rating"),
    )
    days = sketches.sketch_counts(ratings, F.col("day"))
    assert days.count() == 7
    twice = sketches.merge_counts(sketches.merge_counts(days.withColumn("week", F.col("batch") % 2), "week"))
    one = sketches.sketch_counts(ratings, F.lit(0))
    got = rows(sketches.estimates(twice))
    assert got == rows(sketches.estimates(one).drop("batch"))
    ((n, users, books),) = got
    assert n == 30_000 and abs(users - 4001) <= 4001 * sketches.COUNT_ERROR and abs(books - 997) <= 997 * sketches.COUNT_ERROR


def test_merged_quantiles_keep_their_rank(spark):
    values = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"), (F.col("id") % 11).alias("day"))
    odd = spark.createDataFrame([(None, 1), (float("nan"), 2)], "v DOUBLE, day BIGINT")
    merged = sketches.merge_quantiles(sketches.sketch_quantiles(values.unionByName(odd), "v", F.col("day")))
    for r in sketches.quantiles_of(merged, (0.0, 0.1, 0.5, 0.99, 1.0)).collect():
        assert abs(r.value / 50_000 - r.prob) <= sketches.RANK_ERROR
