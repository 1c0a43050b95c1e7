"""The best items of every user, exactly, without scoring most of the items.

Items are put into blocks in order of the length of their vector, longest first. Vectors are cut into ``PARTS`` parts; by
Cauchy-Schwarz no item of a block scores more for a user than the sum, over the parts, of the length of the user's part times
that of the longest such part in the block. So the n-th best score that a user has seen so far rules out every
block whose bound is below it. Blocks are taken in rounds of 1, 1, 2, 4, 8, ..., so that the number of rounds is the logarithm
of their number, and what one round finds prunes the next.

Blocks are what is skipped, tiles of many blocks are what moves: a user goes to a tile once if any of its blocks may still hold
something better, and is spared the other blocks there. So what moves grows with users times tiles, not times blocks, and
a tile that no user is left for moves nothing.

The result is that of :func:`tomewise.operators.topk.best_items`. On vectors of equal length in all directions nothing can be
skipped and this is the slower of the two; factors of popular and unpopular books differ a lot.
"""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewise.operators.ordering import number_rows
from tomewise.operators.topk import (
    _LEAST_USERS, PARTS, Search, _block, _lengths, _seen_cells, _vectors, block_rows, cells_by_slice, found_table, rank_per_user,
)
from tomewise.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ITEMS_PER_BLOCK = 16384
# What a tile found: rows as they are found, and one without a user that says how many pairs were scored.
_OUT = "user_id INT, book_id INT, prediction DOUBLE, scored BIGINT"


def _part_lengths(features: Column, width: int) -> list[Column]:
    """The lengths of the parts of a vector of ``width`` entries."""
    step = -(-width // PARTS)
    square = lambda at: F.aggregate(
        F.slice(features, at + 1, min(step, width - at)), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")
    )
    return [F.sqrt(square(at)) for at in range(0, width, step)]


def in_blocks(item_factors: DataFrame, width: int, items_per_block: int) -> tuple[DataFrame, list[list[float]]]:
    """(id, features, item_block) with blocks in order of length, and of each block the longest length of each part."""
    lengths = _part_lengths(F.col("features"), width)
    whole = F.sqrt(sum((x * x for x in lengths), F.lit(0.0)))
    numbered = number_rows(item_factors.select("id", "features", (-whole).alias("order")), ["order", "id"], "place", start=0)
    block = F.floor(F.col("place") / items_per_block).cast("int").alias("item_block")
    blocks = cut(numbered.select("id", "features", block, F.array(*lengths).alias("lengths")))
    longest = blocks.groupBy("item_block").agg(*[F.max(F.col("lengths")[i]).alias(f"l{i}") for i in range(len(lengths))])
    # One row per block of items.
    rows = longest.orderBy("item_block").collect()
    return blocks.drop("lengths"), [[r[f"l{i}"] for i in range(len(lengths))] for r in rows]


def _rounds(blocks: int) -> list[tuple[int, int]]:
    """0, 1, 2-3, 4-7, ... as (first, last)."""
    out, first = [], 0
    while first < blocks:
        last = max(0, 2 * first - 1) if first else 0
        out.append((first, min(last, blocks - 1)))
        first = last + 1
    return out


def _tile_scorer(n: int, decimals: int | None):
    def table(user_id, book_id, prediction, scored) -> pa.Table:
        return pa.table({"user_id": user_id, "book_id": book_id, "prediction": prediction, "scored": scored})

    def scorer(left: pa.Table, items: pa.Table) -> pa.Table:
        is_user = pc.is_null(left["seen"])
        users, rated = left.filter(is_user), left.filter(pc.invert(is_user))
        if not len(users) or not len(items):
            return table(*(pa.array([], kind) for kind in (pa.int32(), pa.int32(), pa.float64(), pa.int64())))
        user_ids, item_ids, block = (c.to_numpy() for c in (users["id"], items["id"], items["item_block"]))
        order = np.lexsort((item_ids, block))
        vectors, item_ids = _vectors(items["features"])[order], item_ids[order]
        lengths = _lengths(vectors)
        _, starts = np.unique(block[order], return_index=True)
        search = Search(_vectors(users["features"]), n, decimals, pc.fill_null(users["nth"], -np.inf).to_numpy())
        cells = cells_by_slice(*_seen_cells(rated, user_ids, item_ids), starts)
        for first, last, (row, col) in zip(starts.tolist(), [*starts.tolist()[1:], len(item_ids)], cells):
            search.take(vectors[first:last], item_ids[first:last], np.fmax.reduce(lengths[first:last], axis=0), row, col)
        found = found_table(search, user_ids)
        total = table(*(pa.array([None], kind) for kind in (pa.int32(), pa.int32(), pa.float64())), pa.array([search.scored], pa.int64()))
        return pa.concat_tables([table(*found.drop(["rank"]).columns, pa.nulls(len(found), pa.int64())), total])

    return scorer


def _scored(visits: DataFrame, items: DataFrame, rated: DataFrame | None, n: int, decimals: int | None, tasks: int) -> DataFrame:
    """What :func:`_tile_scorer` says of every tile and block of users in ``visits (user_block, tile, id, features, nth)``."""
    pair = ["user_block", "tile"]
    kind = visits.schema["features"].dataType
    left = visits.select(*pair, "id", "features", "nth", F.lit(None).cast("array<int>").alias("seen"))
    if rated is not None:
        mine = visits.select(*pair, "id").join(rated, ["id", "tile"])
        nobody = F.lit(None).cast(kind).alias("features"), F.lit(None).cast("double").alias("nth")
        left = left.unionByName(mine.select(*pair, "id", *nobody, "seen"))
    # Items go only where a user is left.
    pairs = visits.select(F.col("user_block").alias("users"), F.col("tile").alias("at")).distinct()
    right = items.join(pairs, F.col("tile") == F.col("at")).select(
        F.col("users").alias("user_block"), F.col("at").alias("tile"), F.col("id").alias("id"), "item_block", F.col("features").alias("features")
    )
    return (
        left.repartition(tasks, *pair).groupBy(*pair)
        .cogroup(right.repartition(tasks, *pair).groupBy(*pair))
        .applyInArrow(_tile_scorer(n, decimals), _OUT)
    )


def best_items_pruned(
    user_factors: DataFrame,
    item_factors: DataFrame,
    n: int,
    seen: DataFrame | None = None,
    decimals: int | None = None,
    users_per_block: int | None = None,
    items_per_block: int = ITEMS_PER_BLOCK,
) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(user_id, book_id, prediction, rank) of the ``n`` best items of every user, as :func:`best_items`, and for every round
    how many pairs of a user and an item block were scored and how many skipped."""
    spark = user_factors.sparkSession
    first = item_factors.select(F.size("features").alias("width")).first()
    if first is None:
        return spark.createDataFrame([], "user_id INT, book_id INT, prediction DOUBLE, rank INT"), []
    items, longest = in_blocks(item_factors.select("id", "features"), first.width, items_per_block)
    lengths = F.array(*_part_lengths(F.col("features"), first.width))
    users = cut(user_factors.select("id", "features", lengths.alias("lengths")))
    (n_users, user_rows), (_, item_rows) = block_rows(users), block_rows(items)
    per_tile, cores = max(1, item_rows // items_per_block), spark.sparkContext.defaultParallelism
    rated = None
    if seen is not None:
        placed = items.select(F.col("id").alias("book_id"), "item_block")
        rated = cut(
            seen.select(F.col("user_id").alias("id"), "book_id").dropna().join(placed, "book_id")
            .groupBy("id", "item_block").agg(F.collect_set("book_id").alias("seen"))
        )
    # A score that rounds up to the n-th best may still win by its id; a product may be off by rounding.
    slack = 10.0**-decimals if decimals is not None else 1e-9
    single = user_factors.schema["features"].dataType.elementType.typeName() == "float"
    error = 1 + 2 * first.width * float(np.finfo("float32" if single else "float64").eps)
    best, counts = None, []
    for low, high in _rounds(len(longest)):
        asked = users.withColumn("nth", F.lit(None).cast("double"))
        if best is not None:
            nth = best.filter(F.col("rank") == n).select(F.col("user_id").alias("id"), F.col("prediction").alias("nth"))
            asked = users.join(nth, "id", "left")
        ends = range(low, high + 1, per_tile)
        most = [[max(part) for part in zip(*longest[at : min(at + per_tile, high + 1)])] for at in ends]
        table = F.array(*[F.array(*[F.lit(float(x)) for x in tile]) for tile in most])
        bound = lambda j: F.aggregate(
            F.zip_with("lengths", table[j], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
        )
        worth = lambda j: F.col("nth").isNull() | (bound(j) * F.lit(error) + slack >= F.col("nth"))
        tiles = F.filter(F.sequence(F.lit(0), F.lit(len(most) - 1)), worth)
        busy = min(-(-4 * cores // len(most)), -(-n_users // _LEAST_USERS))
        user_blocks = max(1, -(-n_users // (users_per_block or user_rows)), busy)
        visits = asked.select(_block("id", user_blocks).alias("user_block"), F.explode(tiles).alias("tile"), "id", "features", "nth")
        in_round = F.col("item_block").between(low, high)
        tile = F.floor((F.col("item_block") - low) / per_tile).cast("int").alias("tile")
        mine = rated.filter(in_round).select("id", tile, "seen") if rated is not None else None
        here = items.filter(in_round).select("id", "item_block", tile, "features")
        found = cut(_scored(visits, here, mine, n, decimals, 2 * user_blocks * len(most)))
        scored = found.agg(F.sum("scored")).first()[0] or 0
        counts.append((scored, n_users * (high - low + 1) - scored))
        if not scored:
            continue
        found = found.filter("user_id IS NOT NULL").drop("scored")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = cut(rank_per_user(found, n))
    return best, counts
