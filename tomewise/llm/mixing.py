"""Mixing sources to target weights (operator 1), in DataFrame functions only.

Every document is a leaf's: a path through a tree of ``levels`` (domain, language, source). Weights are
whole numbers per node and level; where none is given a node weighs 1. A budget of tokens flows from the
root down. At each node it is shared among the children by weight, but a child never gets more than its
subtree can give (``max_epochs`` times its tokens); what it cannot take goes to its siblings by weight.
Since a node never gets more than its subtree can give, a shortage is made up among siblings first and
reaches the siblings of an ancestor only when a whole subtree runs out.

A leaf reads its documents in epochs, each in an order of its own by a seeded hash, and takes a prefix of
that stream as long as its budget: whole epochs, then documents of the next epoch until the budget is met, the
last of them in part (``tokens_taken``). Where in the hash order that prefix ends is found by summing tokens per
hash bucket twice, so that no leaf is ever sorted and only a bucket of a bucket is put in order.

Null parts of a path are the node ``unknown``. Documents without words (null or empty) carry no tokens; they
are taken when they stand before the end of the prefix. Rows that agree in all key columns are in one place of the
order and taken or left together, each in part at the end. An empty table gives no rows.
Other columns are kept, so names that start with ``_`` are reserved.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewise.llm.common import WORD, cut

UNKNOWN = "unknown"
MAX_WEIGHT = 10_000
# Tables of a row per leaf are broadcast up to this many rows, and joined by shuffles beyond.
SMALL_ROWS = 50_000
BUCKET_BITS = 10
HASH_DIGITS = 15


def word_tokens(text: str) -> Column:
    """Words of a text: its tokens here."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """``df`` written down, and to be broadcast if it is short."""
    df = cut(df)
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def leaf_totals(docs: DataFrame, levels: list[str], tokens: str) -> DataFrame:
    return docs.groupBy(*levels).agg(F.sum(tokens).cast("long").alias("_tokens"))


def _weight(weights: dict, level: str) -> Column:
    """Weight of a node by its name, 1 where none is given."""
    given = weights.get(level, {})
    if any(not 1 <= w <= MAX_WEIGHT for w in given.values()):
        raise ValueError(f"weights are whole numbers from 1 to {MAX_WEIGHT}")
    cases = reduce(lambda c, kv: c.when(F.col(level) == kv[0], F.lit(kv[1])), given.items(), F) if given else None
    return (cases.otherwise(F.lit(1)) if given else F.lit(1)).cast("long")


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(19)")


def share_budget(
    totals: DataFrame, levels: list[str], weights: dict, budget: int | tuple[int, int], max_epochs: int
) -> DataFrame:
    """``totals`` with the token budget ``_budget`` of every leaf.

    At a node, children are put in order of capacity per weight. Walking up, a child that can take less
    than its share of what is left, by its weight among those not yet served, takes all it has; from the
    first that can take its share on, everybody gets the share. Its windows see a row per node, not documents.
    """
    everything = Window.partitionBy(F.lit(0))
    able = totals.withColumn("_able", F.col("_tokens") * max_epochs).withColumn("_all", F.sum("_tokens").over(everything))
    wanted = F.lit(budget) if isinstance(budget, int) else F.expr(f"_all * {budget[0]} div {budget[1]}")
    able = able.withColumn("_budget", F.least(wanted.cast("long"), F.sum("_able").over(everything))).drop("_all")
    for i, level in enumerate(levels):
        node, parent = levels[: i + 1], levels[:i] or [F.lit(0)]
        inner = able.groupBy(*node).agg(F.sum("_able").alias("_node_able"), F.first("_budget").alias("_of_parent"))
        inner = inner.withColumn("_w", _weight(weights, level))
        order = Window.partitionBy(*parent).orderBy(
            (F.col("_node_able").cast("double") / F.col("_w")), F.col("_node_able"), F.col(level)
        )
        so_far = order.rowsBetween(Window.unboundedPreceding, -1)
        from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        left = F.col("_of_parent") - F.coalesce(F.sum("_node_able").over(so_far), F.lit(0))
        placed = inner.withColumn("_left", left).withColumn("_weights", F.sum("_w").over(from_here))
        short = _wide("_node_able") * _wide("_weights") <= _wide("_left") * _wide("_w")
        placed = placed.withColumn("_short", short)
        # Values at the first child that is not short; all from there on share by weight.
        first = Window.partitionBy(*parent)
        at = lambda c: F.min(F.when(~F.col("_short"), F.struct(F.col("_node_able").cast("double") / F.col("_w"), "_node_able", level, c))).over(first)[c]
        share = F.expr("CAST(_to_share AS DECIMAL(19)) * CAST(_w AS DECIMAL(19)) div _among")
        placed = (
            placed.withColumn("_to_share", at("_left"))
            .withColumn("_among", at("_weights"))
            .withColumn("_own", F.when(F.col("_short"), F.col("_node_able")).otherwise(F.least(share, F.col("_node_able"))))
            .select(*node, "_own")
        )
        # Null-free keys, and a row per node: the join multiplies nothing.
        able = able.join(placed, node).withColumn("_budget", F.col("_own")).drop("_own")
    return able.drop("_able")


def _key(seed: int, epoch: str | Column, keys: list[str]) -> Column:
    """Place in the order of an epoch: 60 bits of a hash of the seed, the epoch and the key columns."""
    parts = [F.lit(seed).cast("string"), (F.col(epoch) if isinstance(epoch, str) else epoch).cast("string")]
    parts += [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_DIGITS), 16, 10).cast("long")


def _bucket(depth: int) -> Column:
    return F.shiftright("_key", 4 * HASH_DIGITS - BUCKET_BITS * depth)


def prefix_ends(docs: DataFrame, levels: list[str], tokens: str) -> DataFrame:
    """(levels, _end, _end_before): the key of the document in which each leaf's last epoch ends, and the
    tokens before it there. ``docs`` has ``_key`` and ``_rest``, the tokens to take of that epoch.

    Leaves whose rest is 0, and rests beyond all documents, have no row.
    """
    found = docs.filter(F.col("_rest") > 0).withColumn("_before", F.lit(0).cast("long"))
    for depth in (1, 2, 3):
        # The last step orders documents; those before order buckets, which map-side sums make few.
        step = _bucket(depth) if depth < 3 else F.col("_key")
        sums = found.groupBy(*levels, step.alias("_step")).agg(
            F.sum(tokens).alias("_sum"), F.first("_rest").alias("_rest_"), F.first("_before").alias("_base")
        )
        upto = Window.partitionBy(*levels).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_at", F.col("_base") + F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
        hit = sums.filter((F.col("_at") < F.col("_rest_")) & (F.col("_at") + F.col("_sum") >= F.col("_rest_")))
        if depth == 3:
            return hit.select(*levels, F.col("_step").alias("_end"), F.col("_at").alias("_end_before"))
        hit = hit.select(*levels, F.col("_step").alias("_hit"), F.col("_at").alias("_hit_before"))
        found = (
            found.join(_small(hit), levels)
            .filter(step == F.col("_hit"))
            .withColumn("_before", F.col("_hit_before"))
            .drop("_hit", "_hit_before")
        )


def select_epochs(
    docs: DataFrame,
    levels: list[str],
    weights: dict,
    budget: int | tuple[int, int],
    keys: list[str],
    tokens: str = "n_tokens",
    max_epochs: int = 4,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with a row for every time a document is taken: ``epoch`` from 0 and ``tokens_taken``.

    ``budget`` is a number of tokens, or a share (numerator, denominator) of all there are. ``keys`` tell
    documents apart. Columns of ``docs`` that are named ``epoch`` or ``tokens_taken`` come back as ``input_<name>``.
    """
    for name in ("epoch", "tokens_taken"):
        docs = docs.withColumnRenamed(name, f"input_{name}")
    docs = docs.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in levels})
    # Few columns go through the search for the ends; texts and the rest only meet its result.
    columns = list(dict.fromkeys([*levels, *keys, tokens]))
    narrow = cut(docs.select(*columns))
    docs = narrow if set(docs.columns) <= set(columns) else docs
    leaves = share_budget(leaf_totals(narrow, levels, tokens), levels, weights, budget, max_epochs)
    leaves = _small(
        leaves.select(
            *levels,
            F.expr("CAST(_budget div greatest(_tokens, 1) AS INT)").alias("_whole"),
            (F.col("_budget") % F.greatest(F.col("_tokens"), F.lit(1))).alias("_rest"),
        )
    )
    keyed = narrow.join(leaves, levels).withColumn("_key", _key(seed, "_whole", keys))
    ends = prefix_ends(keyed.select(*levels, tokens, "_key", "_rest"), levels, tokens)
    planned = docs.join(_small(leaves.join(ends, levels, "left")), levels)
    planned = planned.withColumn("_key", _key(seed, "_whole", keys))
    # Tokens of the last epoch: all before its end, up to the rest at the end, none behind.
    part = F.when(F.col("_key") < F.col("_end"), F.col(tokens)).when(
        F.col("_key") == F.col("_end"), F.least(F.col(tokens), F.col("_rest") - F.col("_end_before"))
    )
    planned = planned.withColumn("_part", part)
    times = F.col("_whole") + F.when(F.col("_part").isNotNull(), 1).otherwise(0)
    taken = planned.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    whole = F.col("epoch") < F.col("_whole")
    return taken.withColumn(
        "tokens_taken", F.when(whole, F.col(tokens)).otherwise(F.col("_part")).cast("long")
    ).drop("_whole", "_rest", "_end", "_end_before", "_key", "_part")
