"""Folding in against the fit's own half step, brute force, and rows that nobody touched."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from test_streaming import events, refresh
from tomewise.operators import foldin
from tomewise.operators.foldin import fold_in, non_negative
from tomewise.plans.model import AlsConfig, fit
from tomewise.plans.recommend_job import JobConfig
from tomewise.sources import tables
from tomewise.streaming.foldin import FoldInRefresh

RATING = "user_id INT, book_id INT, rating DOUBLE"


def planted(spark, users=40, books=30):
    pairs = [(u, b) for u in range(users) for b in range(books) if (u * 7919 + b * 104729) % 10 < 5]
    taste = lambda u, b: 1 + 4 * (0.5 * (u * 37 % 101) / 100 * (b * 53 % 97) / 96 + 0.5 * (u * 61 % 89) / 88 * (b * 29 % 83) / 82)
    return spark.createDataFrame([(u, b, taste(u, b)) for u, b in pairs], RATING)


def as_arrays(df):
    return {r.id: np.array(r.features) for r in df.collect()}


@pytest.mark.parametrize("parts", [False, True])
def test_all_users_folded_in_are_the_half_step_of_the_fit(spark, monkeypatch, parts):
    if parts:  # every user in several parts
        monkeypatch.setattr(foldin, "RATINGS_PER_PART", 3)
    ratings, config = planted(spark), AlsConfig(seed=3, rank=6, reg=0.1, max_iter=4)
    model = fit(ratings, config)
    got, want = as_arrays(fold_in(ratings, model.itemFactors, config.reg)), as_arrays(model.userFactors)
    assert got.keys() == want.keys() and len(got) == 40
    assert max(np.abs(got[u] - want[u]).max() for u in want) < 1e-6


def test_solutions_are_the_least_over_many_points():
    rng = np.random.default_rng(5)
    for _ in range(50):
        k = int(rng.integers(1, 9))
        y, r = rng.normal(size=(12, k)), rng.normal(size=12)
        gram, side = y.T @ y + 0.1 * np.eye(k), y.T @ r
        x = non_negative(gram, side)
        slope = gram @ x - side
        # What makes a solution: nothing below zero, no slope where free, none downhill at zero.
        assert (x >= 0).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-8 and (slope[x == 0] > -1e-8).all()


def test_books_against_users_and_what_has_no_factors(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id INT, features ARRAY<FLOAT>")
    ratings = spark.createDataFrame([(1, 7, 3.0), (2, 7, 4.0), (9, 7, 5.0), (9, 8, 5.0)], RATING)
    got = as_arrays(fold_in(ratings, users, 0.5, "book_id", "user_id"))
    assert got.keys() == {7}
    assert np.allclose(got[7], [3 / (1 + 0.5 * 2), 8 / (4 + 0.5 * 2)])
    assert fold_in(ratings.limit(0), users, 0.5).collect() == []
    with pytest.raises(ValueError):
        fold_in(ratings, users, 0.0)


def state_of(spark, tmp_path, **more):
    base = refresh(spark, f"{tmp_path}/out", JobConfig(als=AlsConfig(seed=1, rank=2, max_iter=2), n=2))
    return FoldInRefresh(base.ratings, base.gr_books, base.directory, base.path, base.job, **more)


def test_only_the_touched_change_until_the_refit(spark, tmp_path):
    state = state_of(spark, tmp_path, refit_every=3)
    state(events(spark, range(0, 12)), 0)
    first = rows(state.recs(spark))
    names = {r.username: r.user_id for r in tables.read_versions_before(spark, f"{tmp_path}/out/ratings", 9, state.ratings.schema).collect()}
    one = events(spark, range(40, 44)).filter("username = 'u2'")
    state(one, 1)
    touched = names["u2"]
    second = rows(state.recs(spark))
    assert [r for r in second if r[0] != touched] == [r for r in first if r[0] != touched]
    seen = tables.read_versions_before(spark, f"{tmp_path}/out/ratings", 9, state.ratings.schema).unionByName(state.ratings)
    assert state.recs(spark).join(seen, ["user_id", "book_id"]).count() == 0
    # A replay comes out the same; a batch without ratings changes nothing; the third batch after a refit is one.
    state(one, 1)
    assert rows(state.recs(spark)) == second
    state(events(spark, []), 2)
    assert rows(state.recs(spark)) == second
    state(events(spark, range(44, 60)), 3)
    assert state.last_refit(spark, 9) == 3
    state(events(spark, range(60, 64)), 4)
    for name in ("fit", "fit_users", "fit_recs", "touched_users"):
        assert min(tables.versions(spark, f"{tmp_path}/out/{name}")) >= 3


def test_a_new_user_and_a_new_book_between_refits(spark, tmp_path):
    state = state_of(spark, tmp_path)
    state(events(spark, range(0, 12)), 0)
    old = {r.id for r in state.factors(spark, "books", 1).collect()}
    new = events(spark, [100, 101, 102]).withColumn("ext_book_id", F.expr("CASE arrival WHEN 101 THEN 999 ELSE ext_book_id END"))
    new = new.withColumn("username", F.expr("CASE WHEN arrival > 101 THEN 'newcomer' ELSE username END"))
    state(new, 1)
    books = {r.id for r in state.factors(spark, "books", 2).collect()}
    assert len(books - old) == 1
    users = {r.username: r.user_id for r in tables.read_versions_before(spark, f"{tmp_path}/out/users", 9, "user_id INT, username STRING").collect()}
    assert state.recs(spark).filter(F.col("user_id") == users["newcomer"]).count() == 2


def test_a_job_is_needed(spark, tmp_path):
    with pytest.raises(ValueError):
        FoldInRefresh(*[getattr(refresh(spark, "x"), f) for f in ("ratings", "gr_books", "directory", "path")])
