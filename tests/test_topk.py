import subprocess
import sys

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows
from tomewise.operators.topk import _best_of_slice, _block_scorer, best_items


def frame(spark, ids, matrix):
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)],
        "id INT, features ARRAY<DOUBLE>",
    )


def brute_force(user_ids, users, item_ids, items, n, seen, decimals):
    out = []
    for u, vector in zip(user_ids, users):
        scored = [
            (-round(float(vector @ w), decimals), int(i))
            for i, w in zip(item_ids, items)
            if (u, i) not in seen
        ]
        for rank, (cost, item) in enumerate(sorted(scored)[:n], 1):
            out.append((int(u), item, -cost, rank))
    return sorted(out)


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.integers(0, 1000), st.sampled_from([(3, 4), (50, 7), (1000, 1000)]))
def test_equals_brute_force_for_any_blocking(spark, seed, blocks):
    rng = np.random.default_rng(seed)
    # Small integers, so that many scores are tied.
    users, items = rng.integers(0, 3, (9, 3)), rng.integers(0, 3, (23, 3))
    user_ids, item_ids = rng.permutation(100)[:9], rng.permutation(100)[:23]
    seen = {(int(u), int(i)) for u in user_ids for i in item_ids if rng.random() < 0.3}
    seen |= {(int(user_ids[0]), int(i)) for i in item_ids}
    seen_df = spark.createDataFrame(sorted(seen) * 2 + [(999, 1)], "user_id INT, book_id INT")
    got = best_items(
        frame(spark, user_ids, users),
        frame(spark, item_ids, items),
        5,
        seen=seen_df,
        decimals=6,
        users_per_block=blocks[0],
        items_per_block=blocks[1],
    )
    expected = brute_force(user_ids, users, item_ids, items, 5, seen, 6)
    assert [tuple(r) for r in rows(got)] == expected


@pytest.mark.parametrize("width", [1, 9, 10, 11, 1279, 1280, 1301, 5000])
def test_selection_with_ties_and_masks_at_any_width(width):
    rng = np.random.default_rng(width)
    scores = rng.integers(0, 50, (7, width)).astype("float32")
    scores[rng.random((7, width)) < 0.2] = -np.inf
    scores[3] = -np.inf
    scores[4] = 1.0
    ids = np.sort(rng.permutation(10 * width)[:width])
    got = list(zip(*_best_of_slice(scores, ids, 10)))
    expected = []
    for r, line in enumerate(scores):
        best = sorted((-s, i) for s, i in zip(line, ids) if np.isfinite(s))[:10]
        expected += [(r, i, -s, rank) for rank, (s, i) in enumerate(best, 1)]
    assert got == expected


def test_identical_items_are_listed_by_id(spark):
    got = best_items(
        frame(spark, range(20), np.ones((20, 2))), frame(spark, range(15), np.ones((15, 2))), 10
    )
    assert rows(got) == [(u, i, 2.0, i + 1) for u in range(20) for i in range(10)]


def test_all_seen_and_no_items(spark):
    vectors = frame(spark, [1, 2], np.ones((2, 2)))
    seen = spark.createDataFrame([(1, 1), (1, 2)], "user_id INT, book_id INT")
    assert {r.user_id for r in best_items(vectors, vectors, 3, seen=seen).collect()} == {2}
    assert best_items(vectors, vectors.limit(0), 3).count() == 0


def test_one_user_with_most_of_the_ratings(spark):
    rng = np.random.default_rng(1)
    users, items = rng.random((6, 4)), rng.random((400, 4))
    seen = {(0, i) for i in range(395)} | {(u, u) for u in range(1, 6)}
    got = best_items(
        frame(spark, range(6), users),
        frame(spark, range(400), items),
        10,
        seen=spark.createDataFrame(sorted(seen), "user_id INT, book_id INT"),
        items_per_block=64,
        decimals=9,
    )
    expected = brute_force(range(6), users, range(400), items, 10, seen, 9)
    for ours, theirs in zip(rows(got), expected, strict=True):
        assert ours[:2] == theirs[:2] and ours[2] == pytest.approx(theirs[2])


def test_plan_has_no_cross_join_and_ranks_before_the_shuffle(spark):
    vectors = frame(spark, range(50), np.ones((50, 2)))
    plan = best_items(vectors, vectors, 3, items_per_block=10)._jdf.queryExecution()
    plan = plan.executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") == 2


def test_workers_do_not_need_the_package(tmp_path):
    (tmp_path / "scorer").write_bytes(cloudpickle.dumps(_block_scorer(3, None)))
    load = "import pickle, sys; print(callable(pickle.load(open('scorer', 'rb'))), 'tomewise' in sys.modules)"
    out = subprocess.run(
        [sys.executable, "-c", load], cwd=tmp_path, capture_output=True, text=True, check=True
    )
    assert out.stdout.split() == ["True", "False"]


def test_blocks_are_cut_so_that_little_moves(spark):
    """Many users and few items: no user is copied, where a fixed number of items to a block would copy all of them."""
    vector = F.array(F.lit(1.0)).alias("features")
    users, items = (spark.range(n).select(F.col("id").cast("int").alias("id"), vector) for n in (200_000, 20_000))
    plan = best_items(users, items, 3)._jdf.queryExecution().logical().toString()
    assert "sequence(0, 0" in plan


def test_items_are_read_and_not_sent_to_each_block_of_users(spark):
    rng = np.random.default_rng(4)
    users, items = rng.random((40, 4)), rng.random((5000, 4))
    got = best_items(frame(spark, range(40), users), frame(spark, range(5000), items), 3, decimals=9, users_per_block=10)
    # Only users go to blocks, of which there is one of items, whose n best are the result.
    plan = got._jdf.queryExecution()
    assert plan.logical().toString().count("explode(sequence(0, ") == 1
    assert "Window" not in plan.executedPlan().toString()
    expected = brute_force(range(40), users, range(5000), items, 3, set(), 9)
    assert [tuple(r)[:2] for r in rows(got)] == [e[:2] for e in expected]
