"""Trained models: invariants, and quality on ratings with a planted structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tomewise.operators import recommend, split, stats
from tomewise.plans import model
from tomewise.plans.model import AlsConfig
from tomewise.plans.recommend_job import JobConfig, recommend_job


@pytest.fixture(scope="module")
def planted(spark):
    users = spark.range(300).select(F.col("id").cast("int").alias("user_id"))
    books = spark.range(200).select(F.col("id").cast("int").alias("book_id"))
    u, b = F.col("user_id").cast("long"), F.col("book_id").cast("long")
    taste = 0.5 * F.pmod(u * 37, F.lit(101)) / 100 * F.pmod(b * 53, F.lit(97)) / 96
    taste += 0.5 * F.pmod(u * 61, F.lit(89)) / 88 * F.pmod(b * 29, F.lit(83)) / 82
    pairs = users.crossJoin(books).filter(F.pmod(u * 7919 + b * 104729, F.lit(10)) < 4)
    return pairs.withColumn("rating", 1 + 4 * taste).cache()


@pytest.fixture(scope="module")
def parts(planted):
    bucket = F.pmod(F.col("user_id") * 31 + F.col("book_id") * 17, F.lit(10))
    return split.by_key(planted, bucket, 10)


def test_planted_sizes(planted, parts):
    assert planted.count() == 24_000
    assert [p.count() for p in parts] == [14_400, 4_800, 4_800]


def test_grid_finds_the_planted_structure(parts):
    training, validation, _ = parts
    mean = training.agg(F.avg("rating")).first()[0]
    baseline = stats.rmse(validation.withColumn("prediction", F.lit(mean))).first().rmse
    config = AlsConfig(seed=7)
    metrics = model.grid_metrics(
        training, validation, config, ranks=[4, 8], regs=[0.02, 0.2], parallelism=4
    )
    assert [tuple(r)[:3] for r in metrics.orderBy("grid_pos").collect()] == [
        (0, 4, 0.02),
        (1, 4, 0.2),
        (2, 8, 0.02),
        (3, 8, 0.2),
    ]
    best = model.best_point(metrics).first()
    assert best.rmse < 0.6 * baseline
    chosen = model.tuned(config, metrics)
    assert (chosen.rank, chosen.reg) == (best.rank, best.reg)


def test_best_point_prefers_the_first_of_equals(spark):
    metrics = spark.createDataFrame(
        [(0, 4, 0.1, None, 0), (1, 4, 0.2, 0.5, 9), (2, 8, 0.1, 0.5, 9)],
        "grid_pos INT, rank INT, reg DOUBLE, rmse DOUBLE, scored BIGINT",
    )
    assert model.best_point(metrics).first().grid_pos == 1
    nothing = metrics.filter("grid_pos = 0")
    assert model.tuned(AlsConfig(seed=1), nothing) == AlsConfig(seed=1)


def test_empty_validation_reports_null(parts):
    metrics = model.grid_metrics(
        parts[0], parts[1].limit(0), AlsConfig(seed=1, max_iter=1), ranks=[2], regs=[0.1]
    )
    assert rows(metrics) == [(0, 2, 0.1, None, 0)]


def test_same_seed_same_model(planted):
    config = AlsConfig(seed=3, rank=4, max_iter=2)
    first, again = model.fit(planted, config), model.fit(planted, config)
    assert rows(first.userFactors.select("id", F.col("features")[0])) == rows(
        again.userFactors.select("id", F.col("features")[0])
    )


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_a_fit_refuses_null_and_nan(spark, planted, bad):
    rows = spark.createDataFrame([(1, 1, bad)], planted.schema)
    with pytest.raises(Exception, match="(?i)null|nan"):
        model.fit(planted.unionByName(rows), AlsConfig(seed=3, rank=2, max_iter=1))


def test_ratings_of_any_scale_are_trained_on(spark, planted):
    wide = spark.createDataFrame([(9001, 1, 9.0), (9002, 2, 0.5)], planted.schema)
    fitted = model.fit(planted.unionByName(wide), AlsConfig(seed=3, rank=2, max_iter=1))
    assert fitted.userFactors.count() == 302


def test_blocks_do_not_follow_the_number_of_ratings():
    config = AlsConfig(seed=3)
    few, many = config.estimator(49_999_999), config.estimator(50_000_000)
    assert few.getNumUserBlocks() == many.getNumUserBlocks() == config.blocks
    with pytest.raises(ValueError, match="need 11 blocks"):
        config.estimator(50_000_001)


def test_a_job_has_blocks_for_all_its_ratings(planted, monkeypatch):
    assert AlsConfig(seed=3).for_ratings(50_000_000).blocks == 10
    assert AlsConfig(seed=3).for_ratings(10**13).blocks == 2_000_000
    monkeypatch.setattr(model, "RATINGS_PER_BLOCK", planted.count() // 12)
    used, make = [], AlsConfig.estimator
    monkeypatch.setattr(AlsConfig, "estimator", lambda self, n: used.append(self.blocks) or make(self, n))
    job = JobConfig(als=AlsConfig(seed=7, rank=2, max_iter=1), tune=True, ranks=(2,), regs=(0.1,))
    assert recommend_job(planted, job).count() == 3000
    # The grid over the training part, and the fit over all.
    assert len(used) == 2 and used[0] == used[1] > 10


def test_unknown_user_is_dropped_by_scoring(spark, planted):
    fitted = model.fit(planted, AlsConfig(seed=3, rank=2, max_iter=1))
    df = spark.createDataFrame([(1, 1), (10_000, 1), (1, 10_000)], "user_id INT, book_id INT")
    assert model.score(fitted, df).count() == 1
    got = recommend.top_n_for(fitted, df.select("user_id"), 3)
    assert {r.user_id for r in got.collect()} == {1}


def test_exact_unseen_top_n_is_brute_force(planted):
    fitted = model.fit(planted, AlsConfig(seed=7, rank=5, max_iter=3))
    got = recommend.unseen_top_n(fitted, planted, 10).collect()
    users = {r.id: np.array(r.features) for r in fitted.userFactors.collect()}
    items = {r.id: np.array(r.features) for r in fitted.itemFactors.collect()}
    seen = {(r.user_id, r.book_id) for r in planted.collect()}
    per_user = {}
    for r in got:
        assert (r.user_id, r.book_id) not in seen
        assert r.prediction == pytest.approx(users[r.user_id] @ items[r.book_id], abs=1e-5)
        per_user.setdefault(r.user_id, []).append(r.prediction)
    for user, scores in per_user.items():
        best = sorted((users[user] @ v for i, v in items.items() if (user, i) not in seen))[-10:]
        assert sorted(scores) == pytest.approx(best, abs=1e-5)
    assert len(per_user) == 300 and len(got) == 3000


def test_exact_and_spark_agree_where_nothing_is_seen(planted):
    fitted = model.fit(planted, AlsConfig(seed=7, rank=5, max_iter=3))
    ours = recommend.unseen_top_n(fitted, planted.limit(0), 5)
    theirs = recommend.top_n(fitted, 5)
    by_user = lambda df: {
        r.user_id: r.s for r in df.groupBy("user_id").agg(F.sum("prediction").alias("s")).collect()
    }
    assert by_user(ours) == pytest.approx(by_user(theirs), rel=1e-5)


def test_job_modes(planted):
    als = AlsConfig(seed=7, rank=4, max_iter=2)
    exact = recommend_job(planted, JobConfig(als=als, n=5))
    after = recommend_job(planted, JobConfig(als=als, n=5, unseen="filter_after"))
    assert exact.count() == 1500 and after.count() < 1500
    assert after.join(planted, ["user_id", "book_id"]).count() == 0
    late = recommend_job(
        planted,
        JobConfig(
            als=als, n=5, tune=True, ranks=(2,), regs=(0.1, 0.2), fit_on="train", min_user_id=250
        ),
    )
    assert {r.user_id for r in late.select("user_id").distinct().collect()} == set(range(251, 300))


def test_tuning_with_sparks_splitter(planted):
    found = model.tune_by_split(
        planted, AlsConfig(seed=7, max_iter=2), ranks=[2], regs=[0.1, 0.2], parallelism=2
    )
    assert len(found.validationMetrics) == 2
    assert found.bestModel.rank == 2
