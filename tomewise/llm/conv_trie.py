"""The prefix trie of conversations, from vertical bitmaps (operator 11).

Conversations are sequences of turns (role, text). A node of depth d stands for a distinct sequence of d turns that some
conversations, its members, begin with; the root has depth 0 and all of them.

1. *Order.* Turns get their place in the conversation from a numbering of all rows by ranges, so that no conversation
   has to fit into a task. From here on a turn is two 64-bit hashes of place, role and text, and its size; a sequence is
   the exclusive or of its turns' hashes, 128 bits, beside its length.
2. *Shards.* Conversations are dealt into shards of about ``SHARD`` turns by a hash of their id, and cut into bands of
   ``BAND`` places, so that a shard is bounded however long one conversation is; a band starts from the sequences
   that its conversations have by then. A shard has an index from (place, turn) to the bitset of its conversations that
   have this turn there. Going down from a node, its bitset intersected with a posting of the next place is a child, the
   bits are counted, and those that have no further turn are the child's list of ends. The next child is the posting
   of the first conversation that is not in one yet, so there is an intersection per node and not per pair.
3. *Nodes.* A node of the trie is what the shards say of its sequence, added up: its members are spread over
   shards, so a beginning that a third of all conversations share is a row of each shard.
4. *Subtrees.* A node is named by its smallest member and its depth. The nodes with one smallest member form a
   chain down to that conversation's end, and hang on a node of another chain. Sums over whole chains with all that hangs
   on them are found by doubling the distance to the chain above, in about as many rounds as the logarithm of how
   deep chains hang on each other; running totals over ranges of (conversation, depth) give every node its share.
5. *Ends.* Ids of members that end in a node are joined in runs of ``RUN`` numbers, and the runs stream through the digest.

Rows are ordered by turn (null first); rows with the same turn follow each other by role, by the first 64 characters
of their text, and by a hash of it. A null role or text is empty. Rows without a conv_id belong to no conversation
and are left out. Repeated rows are repeated turns. Texts may have any length; they are read once. An empty
table has no nodes, not even a root. Other columns are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewise.llm.common import cut, cut_at, drop_table, tasks
from tomewise.operators.ordering import in_ranges, number_rows

SHARD, BAND, RUN = 1 << 15, 1 << 12, 1 << 16
FAMILY, HEADS = 5, 9
KEY = ["depth", "x1", "x2"]


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, size) of ``turns (conv_id, turn, role, text)``: places count from 1 in each conversation,
    and two hashes stand for role and text. Written down."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    named = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text("role").alias("role"), text("text").alias("text"),
    )
    narrow = named.select(
        "conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"),
        F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("turn"), "text", "role").alias("t2"),
        F.octet_length("text").cast("long").alias("size"),
    )
    numbered = cut(
        number_rows(narrow, ["conv_id", "turn", "role", "head", "t1", "t2"], "number", repeats=True)
        .select("conv_id", "number", "t1", "t2", "size")
    )
    first = numbered.groupBy("conv_id").agg(F.min("number").alias("first"))
    return cut(numbered.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("first") + 1).alias("place"), "t1", "t2", "size"))


def lengths(ordered_turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns)."""
    return ordered_turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))


def with_family_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordered turns and lengths of the conversations rebuilt: c begins with the first h turns of c - c % ``FAMILY``, as
    many as there are, and goes on with its own turns behind its first h, where h is crc32 of its decimal id modulo ``HEADS``.
    At most ``FAMILY`` conversations share a beginning."""
    own = lengths(turns)
    c = F.col("conv_id")
    plans = own.withColumn("base", c - c % FAMILY).withColumn("h", F.crc32(c.cast("string")) % HEADS)
    heads = own.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns"))
    plans = plans.join(heads, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    plans = cut(plans.select("conv_id", "base", "h", "taken", "n_turns"))
    rest = turns.join(plans.select("conv_id", "h", "taken"), "conv_id").filter(F.col("place") > F.col("h"))
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "t1", "t2", "size")
    first = turns.filter(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    begun = first.join(plans.select("conv_id", "base", "h"), "base").filter(F.col("place") <= F.col("h"))
    rebuilt = cut(begun.select("conv_id", "place", "t1", "t2", "size").unionByName(rest))
    left = F.greatest(F.col("n_turns") - F.col("h"), F.lit(0)) + F.col("taken")
    return rebuilt, cut(plans.select("conv_id", left.alias("n_turns")))


def _bits(value: int) -> np.ndarray:
    """The places of the bits of a bitset."""
    size = (value.bit_length() + 7) // 8
    return np.flatnonzero(np.unpackbits(np.frombuffer(value.to_bytes(size, "little"), np.uint8), bitorder="little"))


NODES = "depth BIGINT, x1 BIGINT, x2 BIGINT, p1 BIGINT, p2 BIGINT, n BIGINT, conv_id BIGINT, size BIGINT, ends ARRAY<BIGINT>"


def shard_nodes(t: pa.Table) -> pa.Table:
    """The nodes of one band of one shard: rows (conv_id, place, f1, f2, size, s1, s2, n_turns), where f hashes place and
    turn and s is the sequence before the band."""
    conv, place = t["conv_id"].to_numpy(), t["place"].to_numpy()
    order = np.lexsort((place, conv))
    conv, place = conv[order], place[order]
    f1, f2, size, s1, s2, n_turns = (t[c].to_numpy()[order].tolist() for c in ("f1", "f2", "size", "s1", "s2", "n_turns"))
    ids, at, mine = np.unique(conv, return_index=True, return_inverse=True)
    start = int(place.min())
    # Vertical: for each place, which conversations have a turn there, which end there, and which say what.
    postings: dict[tuple[int, int, int], int] = {}
    there: dict[int, int] = {}
    ending: dict[int, int] = {}
    begun: dict[tuple[int, int], int] = {}
    for row, (i, p) in enumerate(zip(mine.tolist(), place.tolist())):
        bit = 1 << i
        key = p, f1[row], f2[row]
        postings[key] = postings.get(key, 0) | bit
        there[p] = there.get(p, 0) | bit
        if p == n_turns[row]:
            ending[p] = ending.get(p, 0) | bit
        if p == start:
            begun[s1[row], s2[row]] = begun.get((s1[row], s2[row]), 0) | bit
    first = at.tolist()
    found: list[list] = [[] for _ in range(9)]
    ahead = [(start - 1, x1, x2, members) for (x1, x2), members in begun.items()]
    while ahead:
        depth, x1, x2, members = ahead.pop()
        left, p = members & there.get(depth + 1, 0), depth + 1
        while left:
            i = (left & -left).bit_length() - 1
            row = first[i] + p - start
            child = members & postings[p, f1[row], f2[row]]
            left &= ~child
            y1, y2, done = x1 ^ f1[row], x2 ^ f2[row], child & ending.get(p, 0)
            ends = ids[_bits(done)].tolist() if done else []
            node = p, y1, y2, x1, x2, child.bit_count(), int(ids[i]), size[row], ends
            for column, value in zip(found, node):
                column.append(value)
            if child != done:
                ahead.append((p, y1, y2, child))
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())]
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(names, found, kinds)})


def _sharded(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns with their shard, their band, and the sequence before the band."""
    total = convs.agg(F.sum("n_turns")).first()[0] or 0
    blocks = max(1, -(-total // SHARD))
    hashed = turns.join(convs, "conv_id").select(
        "conv_id", "place", "size", "n_turns",
        F.xxhash64("place", "t1", "t2").alias("f1"), F.xxhash64("t2", "place", "t1").alias("f2"),
        F.pmod(F.xxhash64("conv_id"), F.lit(blocks)).alias("block"),
        F.floor((F.col("place") - 1) / BAND).cast("long").alias("band"),
    )
    # Only conversations that are longer than a band have any; a row for each of their bands.
    long = hashed.filter(F.col("n_turns") > BAND).groupBy("conv_id", "band").agg(
        F.bit_xor("f1").alias("b1"), F.bit_xor("f2").alias("b2")
    )
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = long.select("conv_id", "band", F.bit_xor("b1").over(before).alias("s1"), F.bit_xor("b2").over(before).alias("s2"))
    zero = F.lit(0).cast("long")
    return hashed.join(starts, ["conv_id", "band"], "left").withColumns(
        {"s1": F.coalesce("s1", zero), "s2": F.coalesce("s2", zero)}
    )


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of rows (depth, x1, x2, conv_id)."""
    run = F.floor(F.col("conv_id") / RUN).cast("long")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    runs = ends.groupBy(*KEY, run.alias("run")).agg(F.array_join(ids, ",").alias("ids"))
    schema = "depth BIGINT, x1 BIGINT, x2 BIGINT, ends_sha256 STRING"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, done = None, None, []
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*done), [pa.int64()] * 3 + [pa.string()])], names=[*KEY, "ends_sha256"]
        )
        for batch in batches:
            for at in range(0, len(batch), 1024):
                for *node, ids_ in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    if node == current:
                        sha.update(b",")
                    else:
                        if current:
                            done.append((*current, sha.hexdigest()))
                        current, sha = node, hashlib.sha256()
                    sha.update(ids_.encode())
            if len(done) > 10_000:
                yield flush()
                done = []
        if current:
            done.append((*current, sha.hexdigest()))
            yield flush()

    placed = runs.repartition(tasks(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "run")
    return placed.select(*KEY, "ids").mapInArrow(digest, schema)


def _chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved): sums over a chain and all that hang on it, from ``chains (conv_id, up, leaves, saved)``.

    After k rounds a chain has the sums of those less than 2^k below, and points 2^k up."""
    spark = chains.sparkSession
    state, path = cut_at(chains)
    while not state.filter("up IS NOT NULL").isEmpty():
        below = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        above = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next_up"))
        step = state.join(below, "conv_id", "left").join(above, "up", "left").select(
            "conv_id",
            F.col("next_up").alias("up"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        before = path
        state, path = cut_at(step)
        drop_table(spark, before)
    return state.drop("up")


def _along_chains(valued: DataFrame) -> DataFrame:
    """``valued (conv_id, depth, leaves, saved, ...)`` with the sums from each node to the end of its chain."""
    ranged = in_ranges(valued, ["conv_id", "depth"])
    totals = ranged.groupBy("_range").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    # A row per range.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0))
    totals = totals.select("_range", before("_l").alias("_l"), before("_s").alias("_s"))
    inside = Window.partitionBy("_range").orderBy("conv_id", "depth")
    upto = lambda name, start: F.col(start) + F.sum(name).over(inside)
    run = ranged.join(F.broadcast(totals), "_range").withColumns({"_l": upto("leaves", "_l"), "_s": upto("saved", "_s")})
    run = cut(run.drop("_range"))
    # Nothing is negative, so the last total is the greatest.
    last = run.groupBy("conv_id").agg(F.max("_l").alias("_last_l"), F.max("_s").alias("_last_s"))
    return run.join(last, "conv_id").withColumns(
        {
            "n_leaves": F.col("_last_l") - F.col("_l") + F.col("leaves"),
            "saved_tokens": F.col("_last_s") - F.col("_s") + F.col("saved"),
        }
    )


def _join_parents(nodes: DataFrame, root: Column) -> DataFrame:
    """``nodes`` with parent_conv_id and n_children. All of depth 1 have one parent, which no join has to bring."""
    above = nodes.filter("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    deep = nodes.filter("depth > 1").join(above, ["depth", "p1", "p2"])
    flat = nodes.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    joined = deep.unionByName(flat).join(children, KEY, "left")
    return joined.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node, from
    ordered turns and the lengths (conv_id, n_turns) of all conversations, also of those without a turn.

    ``saved_tokens`` adds up, over a subtree, the UTF-8 bytes of each node's last text for every member but one;
    ``ends_sha256`` is of the ids, ascending and joined by commas, of the members that have no further turn."""
    sharded = _sharded(turns, convs)
    spark = turns.sparkSession
    parts = sharded.repartition(tasks(spark), "block", "band")
    found = cut(parts.groupBy("block", "band").applyInArrow(shard_nodes, NODES))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n > 0").select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"), "n", "conv_id", zero.alias("size")
    )
    merged = found.groupBy(*KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size")
    )
    nodes = cut(merged.unionByName(root))
    smallest = F.lit(convs.agg(F.min("conv_id")).first()[0]).cast("long")
    placed = cut(
        _join_parents(nodes, smallest)
        .withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("saved", (F.col("n") - 1) * F.col("size"))
        .select(*KEY, "conv_id", "parent_conv_id", "n", "n_children", "leaves", "saved")
    )
    chains = placed.groupBy("conv_id").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("depth").alias("top"),
        F.min_by("parent_conv_id", "depth").alias("up"),
    )
    chains = cut(chains)
    totals = _chain_totals(chains.select("conv_id", "up", "leaves", "saved"))
    hung = chains.filter("up IS NOT NULL").select("conv_id", "up", "top").join(totals, "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    valued = placed.join(hung, ["conv_id", "depth"], "left").withColumns(
        {
            "leaves": F.col("leaves") + F.coalesce("more_leaves", zero),
            "saved": F.col("saved") + F.coalesce("more_saved", zero),
        }
    )
    ends = found.select(*KEY, F.explode("ends").alias("conv_id"))
    turnless = convs.filter("n_turns = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id")
    digests = _digests(ends.unionByName(turnless))
    summed = _along_chains(valued.drop("more_leaves", "more_saved"))
    return summed.join(digests, KEY, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
