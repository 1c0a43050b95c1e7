"""Approximate nearest neighbours by a hash-prefix forest (operator 6).

A vector has a long hash string per tree: the signs of its products with random directions, 64 bits. A tree
over a set of vectors is the sorted array of their strings. A query descends each tree by binary search to the
longest prefix it shares with any entry, and then ascends all trees at the same time, a bit at a time: at depth x
the candidates are all entries that share at least x bits with the query in any tree. It stops at the
deepest x at which the trees together hold ``share`` entries per indexed vector and at least ``LEAST``,
and ranks the candidates by exact distance.

The index is a table: each row is a block of vectors with its sorted arrays, written once and read twice. The first
pass counts the entries at each depth over all blocks and trees (searches in sorted arrays), the second scores.
Queries are a stated part of the rows; they are taken in blocks of bounded size, each broadcast and held against all rows.

Equal vectors are indexed once, with their ``k + 1`` smallest ids, so a vector that a third of the rows share costs no
more than another and all ties are seen. Vectors that are null, zero, hold null or non-finite numbers, or differ in
length from most take no part, as queries or candidates. Null ids take no part. An id that is repeated has one vector: of those
that take part the first, number by number.
Distances are Euclidean, in double precision on the original numbers; ties go to the smaller id.

``share`` decides recall against work. Directions without structure, as in the test table where the nearest of 50,000
vectors is hardly nearer than the rest, are the worst case: recall of 0.9 needs half of all vectors as candidates.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewise.llm.common import cut

TREES, BITS, SEED = 24, 64, 11
SHARE, LEAST = 0.75, 4000
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
INDEX = "n INT, ids BINARY, id_bounds BINARY, vectors BINARY, keys BINARY, orders BINARY"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("embedding").alias("n")).count()
    usual = sizes.orderBy(F.desc("count"), "n").select("n").first()
    known = good.filter(F.size("embedding") == (usual.n if usual else 0))
    return known.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def distinct_vectors(good: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): every different vector once, with its k + 1 smallest ids in order."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    # The rank is cut before the shuffle as well, so a hot vector sends few rows per task.
    few = good.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def directions(size: int, trees: int = TREES) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(size, trees * BITS)).astype(np.float32)


def hash_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """vectors x trees: the first bit of a string is the highest of its 64."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    signs = ((x / scale).astype(np.float32) @ planes) > 0
    packed = np.packbits(signs.reshape(len(x), -1, BITS), axis=2)
    return packed.view(">u8")[:, :, 0].astype(np.uint64)


def _index_builder(size: int):
    planes = directions(size)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = part.column(0).flatten().to_numpy().reshape(-1, size).astype(np.float64)
                ids = part.column(1)
                bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype("<i4")
                keys = hash_strings(x, planes).T
                order = np.argsort(keys, axis=1, kind="stable")
                row = {
                    "n": len(x),
                    "ids": ids.flatten().to_numpy().astype("<i8").tobytes(),
                    "id_bounds": bounds.tobytes(),
                    "vectors": x.tobytes(),
                    "keys": np.take_along_axis(keys, order, 1).astype("<u8").tobytes(),
                    "orders": order.astype("<i4").tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], pa.schema([("n", pa.int32()), *((k, pa.binary()) for k in row if k != "n")]))

    return build


@dataclass
class Block:
    """A row of the index."""

    ids: np.ndarray
    id_bounds: np.ndarray
    vectors: np.ndarray
    keys: np.ndarray
    orders: np.ndarray

    @staticmethod
    def of(row: dict) -> "Block":
        n = row["n"]
        view = lambda name, kind: np.frombuffer(row[name], kind)
        return Block(
            view("ids", "<i8"), view("id_bounds", "<i4"), view("vectors", "<f8").reshape(n, -1),
            view("keys", "<u8").reshape(-1, n), view("orders", "<i4").reshape(-1, n),
        )

    def span(self, tree: int, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of a tree begin and end that share ``depth`` bits with each string."""
        if depth == 0:
            return np.zeros(len(strings), int), np.full(len(strings), len(self.vectors))
        rest = np.uint64((1 << (BITS - depth)) - 1)
        low, high = strings & ~rest, strings | rest
        return np.searchsorted(self.keys[tree], low, "left"), np.searchsorted(self.keys[tree], high, "right")


@dataclass
class Queries:
    ids: np.ndarray
    vectors: np.ndarray
    strings: np.ndarray
    depth: np.ndarray | None = None


def _counter(queries):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = cloudpickle.loads(queries.value)
        total = np.zeros((len(q.ids), BITS + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                for tree in range(len(block.keys)):
                    for depth in range(BITS + 1):
                        low, high = block.span(tree, q.strings[:, tree], depth)
                        total[:, depth] += high - low
                        if (high - low).max() <= 1 and depth:
                            # Deeper down there is at most one entry left; it is never decisive.
                            break
        at, depth = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(depth, pa.int32()), pa.array(total[at, depth])],
            names=["q", "depth", "entries"],
        )

    return count


def _scorer(queries, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = cloudpickle.loads(queries.value)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _score_block(Block.of(row), q, k)

    return score


def _score_block(block: Block, q: Queries, k: int) -> Iterator[pa.RecordBatch]:
    spans = []
    for tree in range(len(block.keys)):
        low, high = np.zeros(len(q.ids), int), np.zeros(len(q.ids), int)
        for depth in np.unique(q.depth):
            here = q.depth == depth
            low[here], high[here] = block.span(tree, q.strings[here, tree], int(depth))
        spans.append((low, high))
    squares = (block.vectors**2).sum(axis=1)
    out = []
    for i in range(len(q.ids)):
        member = np.zeros(len(block.vectors), bool)
        for tree, (low, high) in enumerate(spans):
            member[block.orders[tree, low[i] : high[i]]] = True
        found = np.flatnonzero(member)
        if not len(found):
            continue
        # A cheap form of the distance chooses, the plain one decides; the margin is far above its error.
        x = q.vectors[i]
        rough = squares[found] - 2 * (block.vectors[found] @ x)
        if len(found) > k + 1:
            error = 1e-9 * (float(x @ x) + squares[found].max())
            found = found[rough <= np.partition(rough, k)[k] + error]
        exact = np.sqrt(((block.vectors[found] - x) ** 2).sum(axis=1))
        n = block.id_bounds[found + 1] - block.id_bounds[found]
        ids = np.concatenate([block.ids[block.id_bounds[f] : block.id_bounds[f + 1]] for f in found])
        score = np.repeat(exact, n)
        other = ids != q.ids[i]
        ids, score = ids[other], score[other]
        best = np.lexsort((ids, score))[:k]
        out.append((np.full(len(best), q.ids[i]), ids[best], score[best]))
    if out:
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to each vector of ``queries``, which is a part of
    ``vectors`` (both vec_id, embedding); a query is never its own neighbour."""
    spark = vectors.sparkSession
    # Read several times: what an id stands for is found out once.
    good = cut(usable(vectors))
    size = good.select(F.size("embedding").alias("n")).first()
    found = None
    if size:
        once = distinct_vectors(good, k)
        index = cut(once.mapInArrow(_index_builder(size.n), INDEX))
        indexed = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        asked = cut(good.join(queries.select("vec_id").distinct(), "vec_id", "left_semi"))
        n_blocks = max(1, -(-asked.count() // QUERY_ROWS))
        part = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
        for b in range(n_blocks):
            # Bounded: about QUERY_ROWS rows of one vector each.
            rows = asked.filter(part == b).orderBy("vec_id").toArrow()
            if not len(rows):
                continue
            x = rows["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, size.n).astype(np.float64)
            block = Queries(rows["vec_id"].to_numpy(), x, hash_strings(x, directions(size.n)))
            sent = spark.sparkContext.broadcast(cloudpickle.dumps(block))
            counts = index.mapInArrow(_counter(sent), "q INT, depth INT, entries BIGINT")
            enough = max(least, int(share * indexed))
            deepest = (
                counts.groupBy("q", "depth").agg(F.sum("entries").alias("n")).filter(F.col("n") >= enough)
                .groupBy("q").agg(F.max("depth").alias("depth"))
            )
            block.depth = np.zeros(len(block.ids), int)
            for r in deepest.collect():
                block.depth[r.q] = r.depth
            sent = spark.sparkContext.broadcast(cloudpickle.dumps(block))
            some = index.mapInArrow(_scorer(sent, k), "query_id BIGINT, vec_id BIGINT, score DOUBLE")
            found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
