"""Pruned top-n: the rows of the full product, and fewer pairs where lengths differ."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tomewise.operators import topk_pruned
from tomewise.operators.topk import best_items
from tomewise.operators.topk_pruned import _rounds, best_items_pruned

FACTORS = "id INT, features ARRAY<DOUBLE>"


def vectors(spark, seed, n, width, skew=0.0):
    rng = np.random.default_rng(seed)
    lengths = np.exp(-skew * np.arange(n))
    return spark.createDataFrame([(i, (rng.normal(size=width) * lengths[i]).tolist()) for i in range(n)], FACTORS)


@pytest.mark.parametrize("width, skew, decimals", [(8, 0.0, None), (7, 0.05, 6), (3, 0.05, 1)])
def test_rows_are_those_of_the_full_product(spark, width, skew, decimals):
    users, items = vectors(spark, 1, 30, width), vectors(spark, 2, 60, width, skew)
    seen = spark.range(900).select((F.col("id") % 31).cast("int").alias("user_id"), (F.col("id") % 59).cast("int").alias("book_id"))
    for rated in (None, seen.unionByName(seen)):
        got, counts = best_items_pruned(users, items, 5, rated, decimals, items_per_block=9)
        want = best_items(users, items, 5, rated, decimals)
        columns = ["user_id", "rank", "book_id", F.round("prediction", 9)]
        assert rows(got.select(*columns)) == rows(want.select(*columns))
        assert sum(a + b for a, b in counts) == 30 * -(-60 // 9)


def test_long_vectors_first_make_the_rest_unnecessary(spark):
    users, items = vectors(spark, 1, 50, 16), vectors(spark, 2, 300, 16, 0.04)
    _, counts = best_items_pruned(users, items, 5, items_per_block=20)
    scored, skipped = sum(a for a, _ in counts), sum(b for _, b in counts)
    assert scored + skipped == 50 * 15 and skipped > scored


def test_a_user_who_has_seen_the_best_goes_on(spark):
    users, items = vectors(spark, 1, 3, 4), vectors(spark, 2, 40, 4, 0.2)
    seen = spark.createDataFrame([(0, b) for b in range(38)], "user_id INT, book_id INT")
    got, _ = best_items_pruned(users, items, 5, seen, items_per_block=4)
    assert sorted(r.book_id for r in got.filter("user_id = 0").collect()) == [38, 39]


def test_empty_sides(spark):
    some, none = vectors(spark, 1, 4, 2), spark.createDataFrame([], FACTORS)
    assert best_items_pruned(some, none, 3)[0].collect() == []
    assert best_items_pruned(none, some, 3)[0] is None or best_items_pruned(none, some, 3)[0].collect() == []


def test_rounds_double():
    assert _rounds(1) == [(0, 0)] and _rounds(2) == [(0, 0), (1, 1)]
    assert _rounds(9) == [(0, 0), (1, 1), (2, 3), (4, 7), (8, 8)]


def test_a_user_moves_once_per_tile_and_not_per_block(spark, monkeypatch):
    users, items, moved = vectors(spark, 1, 20, 4), vectors(spark, 2, 320, 4), []
    score = topk_pruned._scored
    monkeypatch.setattr(topk_pruned, "_scored", lambda visits, *more: moved.append(visits.count()) or score(visits, *more))
    _, counts = best_items_pruned(users, items, 3, items_per_block=5)
    # 64 blocks in 7 rounds of a tile each.
    assert len(counts) == 7 and sum(moved) <= 20 * 7
