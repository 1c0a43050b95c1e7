"""Half steps in blocks against single keys solved alone, and whole fits against Spark's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_foldin import RATING, as_arrays, planted
from tomewise.operators import foldin, half_step
from tomewise.operators.half_step import non_negative, solve
from tomewise.plans import model
from tomewise.plans.model import AlsConfig


def block(rng, sizes, things, rank):
    ends = np.cumsum(sizes)
    at, ratings = rng.integers(0, things, ends[-1]), rng.integers(1, 6, ends[-1]).astype(np.float32)
    return ends, at.astype(np.int32), ratings, rng.normal(0.3, 0.4, (things, rank)).astype(np.float32)


def alone(ends, at, ratings, vectors, reg):
    out = []
    for a, b in zip([0, *ends[:-1]], ends):
        y, r = vectors[at[a:b]].astype(float), ratings[a:b].astype(float)
        out.append(non_negative(y.T @ y + reg * (b - a) * np.eye(y.shape[1]), y.T @ r))
    return np.array(out)


@pytest.mark.parametrize("rank", [1, 5, 30])
@pytest.mark.parametrize("rounds", [0, 30])
@pytest.mark.parametrize("together", [1 << 12, 1 << 21])
def test_keys_solved_together_are_the_keys_solved_alone(monkeypatch, rank, rounds, together):
    # Without rounds every key is left to the pivoting, with little room keys with many ratings are summed in parts.
    monkeypatch.setattr(half_step, "ROUNDS", rounds)
    monkeypatch.setattr(half_step, "TOGETHER", together)
    rng = np.random.default_rng(rank)
    given = block(rng, [1, 1, 2, 7, 40, 3, 900, 12, 31, 30, 29, 5], 50, rank)
    want = alone(*given, 0.1)
    assert np.abs(solve(*given, 0.1) - want).max() < 1e-5
    guess = rng.random(want.shape) < 0.5
    assert np.abs(solve(*given, 0.1, guess) - want).max() < 1e-5
    assert (want == 0).any() or rank == 1


def sparks(ratings, config):
    return config.estimator(ratings.count()).fit(ratings)


@pytest.mark.parametrize("rank", [2, 40])
def test_a_fit_has_the_factors_of_sparks(spark, rank):
    ratings = planted(spark)
    # Pairs that repeat, and a user of one book.
    ratings = ratings.unionByName(ratings.filter("user_id < 5")).unionByName(spark.createDataFrame([(77, 3, 2.0)], RATING))
    config = AlsConfig(seed=3, rank=rank, reg=0.1, max_iter=4)
    ours, theirs = model.fit(ratings, config), sparks(ratings, config)
    for kind in ("userFactors", "itemFactors"):
        got, want = as_arrays(getattr(ours, kind)), as_arrays(getattr(theirs, kind))
        assert got.keys() == want.keys()
        assert max(np.abs(got[i] - want[i]).max() for i in want) < 1e-4
    assert ours.rank == rank and ours.getColdStartStrategy() == "drop"


def test_solving_sends_no_factors_through_a_shuffle(spark):
    ratings = planted(spark, 60, 40)
    with model.sides(ratings, 4) as (by_user, by_book):
        users = half_step.written(half_step.pack(spark.range(60).select(F.col("id").cast("int"), F.array(*[F.lit(0.1).cast("float")] * 8).alias("features"))))
        step = half_step.half_step(by_book, users, 8, 0.1)
        # All that is shuffled is the ratings, by the blocks that are kept.
        assert step._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0].count("Exchange") == 0
        assert half_step.unpack(step).count() == 40


def test_a_grid_point_is_a_fit(spark):
    ratings = planted(spark)
    training, validation = ratings.filter("(user_id + book_id) % 4 > 0"), ratings.filter("(user_id + book_id) % 4 = 0")
    got = model.grid_metrics(training, validation, AlsConfig(seed=3, max_iter=3), ranks=[2, 4], regs=[0.1, 0.3], parallelism=2)
    for row in got.collect():
        fitted = sparks(training, AlsConfig(seed=3, rank=row.rank, reg=row.reg, max_iter=3))
        found = model.rmse(model.score(fitted, validation)).first()
        assert (row.scored, row.rmse) == (found.scored, pytest.approx(found.rmse, rel=1e-5))


def test_folding_in_sends_no_factors_per_rating(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(foldin, "_in_parts", lambda seen, *rest: parts.append(seen.select("id").distinct().count()))
    monkeypatch.setattr(foldin, "RATINGS_PER_BLOCK", 100)
    ratings, users = planted(spark), [(u, [0.1 * (u % 7), 0.2]) for u in range(30)]
    books = spark.createDataFrame(users, "id INT, features ARRAY<FLOAT>")
    loose = spark.createDataFrame([(None, 3, 2.0), (78, None, 2.0), (79, 1000, 2.0)], RATING)
    got = as_arrays(foldin.fold_in(ratings.unionByName(loose), books, 0.1))
    assert parts == [] and got.keys() == set(range(40))
    y = np.array([v for _, v in users], np.float32).astype(float)
    for u, rated in ratings.toPandas().groupby("user_id"):
        of = y[rated.book_id]
        want = non_negative(of.T @ of + 0.1 * len(of) * np.eye(2), of.T @ rated.rating.to_numpy())
        assert np.abs(got[u] - want).max() < 1e-5


def test_folding_in_writes_no_ratings_where_no_key_has_many(spark, monkeypatch):
    written, cut = [], foldin.cut
    monkeypatch.setattr(foldin, "cut", lambda df: written.append(df.columns) or cut(df))
    books = spark.createDataFrame([(u, [0.1 * (u % 7), 0.2]) for u in range(30)], "id INT, features ARRAY<FLOAT>")
    assert foldin.fold_in(planted(spark), books, 0.1).count() == 40
    assert not any("other_id" in columns for columns in written)


def test_a_fit_starts_from_the_users_and_not_from_their_ratings(spark, monkeypatch):
    ratings, config, seen = planted(spark), AlsConfig(seed=3, rank=4, reg=0.1, max_iter=2), []
    want = as_arrays(sparks(ratings, config).userFactors)
    fit = model.ALS.fit
    monkeypatch.setattr(model.ALS, "fit", lambda als, rows, *rest: seen.append(rows.count()) or fit(als, rows, *rest))
    got = as_arrays(model.fit(ratings, config).userFactors)
    assert max(seen) == len(want) < ratings.count()
    assert max(np.abs(got[u] - want[u]).max() for u in want) < 1e-4


def test_the_grid_is_scored_without_sending_factors_to_ratings(spark, monkeypatch):
    ratings = planted(spark).withColumn("rating", F.col("rating") + 0.1)
    training, validation = ratings.filter("user_id <> 5 AND (user_id + book_id) % 4 > 0"), ratings.filter("(user_id + book_id) % 4 = 0")
    loose = spark.createDataFrame([(None, 3, 2.0), (1, None, 2.0), (1, 3, None), (1, 1000, 2.0)], RATING)
    config = AlsConfig(seed=3, rank=3, reg=0.1, max_iter=2)
    want = model.rmse(model.score(model.fit(training, config), validation)).first()
    monkeypatch.setattr(model, "score", None)
    got = model.grid_metrics(training, validation.unionByName(loose), config, ranks=[3], regs=[0.1]).first()
    assert (got.scored, got.rmse) == (want.scored, pytest.approx(want.rmse, rel=1e-9))
    assert 0 < got.scored < validation.count()
    assert model.grid_metrics(training, validation.limit(0), config, ranks=[3], regs=[0.1]).first()[3:] == (None, 0)
