"""The best-scoring items for every user, from factor vectors.

Every user has to meet every item, but never as a join of rows. The items are written once, longest
first, into the shared folder. A task holds one block of users, reads the items from there slice by
slice, and keeps only the best ``n`` per user. What a user has already rated is masked in each slice,
so that nobody falls short of ``n`` and no over-fetching is needed, however much one user has rated.

So what is shuffled is every user once, and neither items nor what was found per part of them; items
are cut into blocks, and users copied to each, only where users are too few to keep all cores busy,
or items too many to hold their ids. By Cauchy-Schwarz, part by part of the vectors, a user whose
n-th best is above all that a slice can score skips it.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewise.operators.half_step import _folder, _may_hold
from tomewise.session import fresh_dir

# Send the functions themselves, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors that a block holds, of users or of items, and of users that meet all items: what they have rated comes with them.
BLOCK_BYTES, USER_BYTES = 64 << 20, 8 << 20
# Below so many users or items a block is not worth its own reading of the others.
_LEAST_USERS, _LEAST_ITEMS = 1024, 16384
# Items whose ids a task holds.
_MOST_ITEMS = 8 << 20
# Bytes of items in one row of the shared folder, and in what is read of it at once.
_PACK, _GROUP_BYTES = 1 << 20, 16 << 20
# Items that are scored at once, and scores that are held at once.
_SLICE, _SCORES = 2048, 1 << 20
_GROUP = 32
# Parts of a vector whose lengths bound a score.
PARTS = 4
_OUT = "user_id INT, book_id INT, prediction DOUBLE, rank INT"
_PACKED = "block INT, ids BINARY, vectors BINARY"


def _block(key: str, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def block_rows(factors: DataFrame, room: int = BLOCK_BYTES) -> tuple[int, int]:
    """How many rows ``factors (id, features)`` has, and how many of them have ``room``, as a block."""
    kind = factors.schema["features"].dataType.elementType
    found = factors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("features")).alias("width")).first()
    return found.rows, max(1, room // (max(1, found.width or 0) * (4 if kind.typeName() == "float" else 8)))


def _cutoff(scores: np.ndarray, n: int) -> np.ndarray:
    """Per row, a finite bound that at least the n best scores reach.

    The n-th best of the maxima of column groups is such a bound, and is much cheaper to find
    than the n-th best score: only the maxima have to be partitioned.
    """
    width = scores.shape[1]
    group = _GROUP if width >= 4 * n * _GROUP else 1
    whole = width // group * group
    maxima = scores[:, :whole].reshape(len(scores), group, -1).max(axis=1)
    maxima = np.hstack([maxima, scores[:, whole:]])
    lowest = np.finfo(scores.dtype).min
    if maxima.shape[1] <= n:
        return np.full((len(scores), 1), lowest, scores.dtype)
    bound = -np.partition(-maxima, n - 1, axis=1)[:, n - 1 : n]
    return np.maximum(bound, lowest)


def _best_of(row: np.ndarray, item: np.ndarray, score: np.ndarray, n: int):
    """The n best entries of every row with their ranks; equal scores go to the lower id."""
    order = np.lexsort((item, -score, row))
    row, item, score = row[order], item[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[rank < n], item[rank < n], score[rank < n], rank[rank < n] + 1


def _best_of_slice(scores: np.ndarray, item_ids: np.ndarray, n: int):
    """Rows, items and scores of the n best per row."""
    row, col = np.divmod(np.flatnonzero(scores >= _cutoff(scores, n)), scores.shape[1])
    return _best_of(row, item_ids[col], scores[row, col], n)


def _place(ids: np.ndarray, wanted: np.ndarray):
    """Positions of ``wanted`` in ``ids``, the first of equal ones, and which of them were found."""
    order = np.argsort(ids, kind="stable")
    at = order[np.searchsorted(ids, wanted, sorter=order).clip(max=len(ids) - 1)]
    return at, ids[at] == wanted


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A matrix of the vectors, without a copy."""
    if column.null_count:
        raise ValueError("a vector is missing")
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """The lengths of the parts of every vector."""
    step = max(1, -(-vectors.shape[1] // PARTS))
    parts = [vectors[:, at : at + step] for at in range(0, vectors.shape[1], step)]
    return np.sqrt(np.stack([np.einsum("ij,ij->i", p, p, dtype=np.float64) for p in parts], axis=1))


def _seen_cells(rated: pa.Table, user_ids: np.ndarray, item_ids: np.ndarray):
    """Rows and columns of the rated pairs."""
    many = pc.list_value_length(rated["seen"]).to_numpy()
    row, user_known = _place(user_ids, np.repeat(rated["id"].to_numpy(), many))
    col, item_known = _place(item_ids, rated["seen"].combine_chunks().flatten().to_numpy())
    known = user_known & item_known
    return row[known], col[known]


class Search:
    """The n best items of every user of a block, while slices of items pass.

    ``bars`` are scores that a user's n-th best is known to reach. ``scored`` counts the pairs of a user and a slice
    that were not skipped.
    """

    def __init__(self, users: np.ndarray, n: int, decimals: int | None, bars: np.ndarray | None = None):
        self.users, self.n, self.decimals, self.scored = users, n, decimals, 0
        self.lengths = _lengths(users)
        self.bars = np.full(len(users), -np.inf, users.dtype) if bars is None else bars.astype(users.dtype)
        self.score = np.full((len(users), n), -np.inf, users.dtype)
        self.item = np.zeros((len(users), n), np.int64)
        # A score that rounds up to the n-th best may still win by its id.
        self.slack = 10.0**-decimals if decimals is not None else 0.0
        # What a product may be off by.
        self.error = 1 + 2 * users.shape[1] * float(np.finfo(users.dtype).eps)

    def take(self, items: np.ndarray, item_ids: np.ndarray, longest: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
        """One slice, whose parts are not longer than ``longest``; (row, col) are its masked cells in order of the row."""
        possible = (self.lengths @ longest) * self.error + self.slack
        active = np.flatnonzero(~(possible < self.bars))
        self.scored += len(active)
        step = max(1, _SCORES // len(items))
        for at in range(0, len(active), step):
            some = active[at : at + step]
            first, end = some[0], some[-1] + 1
            vectors = self.users[first:end] if end - first == len(some) else self.users[some]
            scores = vectors @ items.T
            here = slice(*np.searchsorted(row, [first, end]))
            place = np.searchsorted(some, row[here])
            masked = some[place] == row[here]
            scores[place[masked], col[here][masked]] = -np.inf
            self._keep(scores, item_ids, some)

    def _keep(self, scores: np.ndarray, item_ids: np.ndarray, some: np.ndarray) -> None:
        lowest = np.finfo(scores.dtype).min
        best = np.fmax.reduce(scores, axis=1)
        better = np.flatnonzero(best >= np.maximum(self.bars[some] - self.slack, lowest))
        if not len(better):
            return
        if len(better) < len(some):
            scores, some = scores[better], some[better]
        cut = np.maximum(_cutoff(scores, self.n), self.bars[some, None]) - self.slack
        row, col = np.divmod(np.flatnonzero(scores >= np.maximum(cut, lowest)), scores.shape[1])
        score, item = scores[row, col], item_ids[col]
        if self.decimals is not None:
            score = np.round(score, self.decimals)
        # Beside what was found before.
        old, place = np.nonzero(self.score[some] > -np.inf)
        score = np.concatenate([self.score[some[old], place], score])
        item = np.concatenate([self.item[some[old], place], item])
        row, item, score, rank = _best_of(np.concatenate([old, row]), item, score, self.n)
        self.score[some[row], rank - 1], self.item[some[row], rank - 1] = score, item
        self.bars[some] = np.fmax(self.bars[some], self.score[some, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, items, scores and ranks."""
        row, place = np.nonzero(self.score > -np.inf)
        return row, self.item[row, place], self.score[row, place], place + 1


def cells_by_slice(row: np.ndarray, col: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells of every slice of columns that begins at ``starts``, in order of the row, columns counted within."""
    at = np.searchsorted(starts, col, side="right") - 1
    order = np.lexsort((row, at))
    row, col, at = row[order], col[order] - starts[at[order]], at[order]
    for low, high in zip(*(np.searchsorted(at, np.arange(len(starts)), side=s) for s in ("left", "right"))):
        yield row[low:high], col[low:high]


def found_table(search: Search, user_ids: np.ndarray) -> pa.Table:
    row, item, score, rank = search.found()
    columns = {
        "user_id": pa.array(user_ids[row], pa.int32()),
        "book_id": pa.array(item.astype(np.int32)),
        "prediction": pa.array(score.astype(np.float64)),
        "rank": pa.array(rank.astype(np.int32)),
    }
    return pa.table(columns)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, features) as rows that hold many of them, all of one block, in the same order."""
    for batch in batches:
        if not len(batch):
            continue
        vectors = _vectors(pa.chunked_array([batch.column(2)]))
        block, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        step = max(1, _PACK // max(1, vectors[:1].nbytes) // _SLICE) * _SLICE
        bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for first, last in zip(bounds, bounds[1:]):
            for at in range(first, last, step):
                some = slice(at, min(at + step, last))
                cells = [pa.array([block[at]], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (ids[some].astype(np.int32), vectors[some]))]
                yield pa.RecordBatch.from_arrays(cells, names=["block", "ids", "vectors"])


def _write_items(items: DataFrame, blocks: int) -> str:
    """The shared folder with ``items (id, features)``, block by block, of each the longest first."""
    length = F.aggregate("features", F.lit(0.0), lambda sum, x: sum + x.cast("double") * x.cast("double"))
    rows = items.select(_block("id", blocks).alias("block"), "id", "features").orderBy("block", length.desc(), "id")
    path = fresh_dir(items.sparkSession, "items")
    writer = rows.mapInArrow(_packed, _PACKED).write.option("compression", "uncompressed")
    writer.option("parquet.block.size", _GROUP_BYTES).parquet(path)
    return path


def _read_items(path: str, block: int, columns: list[str]) -> Iterator[list[pa.Buffer]]:
    """Cells of the packs of one block, in order; a row group is held at a time."""
    fs, folder = _folder(path)
    for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda info: info.base_name):
        if not info.base_name.endswith(".parquet") or info.base_name.startswith((".", "_")):
            continue
        with fs.open_input_file(info.path) as file:
            table = pq.ParquetFile(file)
            for group in range(table.num_row_groups):
                if not _may_hold(table.metadata.row_group(group).column(0).statistics, block):
                    continue
                for batch in table.iter_batches(batch_size=8, row_groups=[group], columns=["block", *columns]):
                    for row in np.flatnonzero(batch.column("block").to_numpy() == block).tolist():
                        yield [batch.column(name)[row].as_buffer() for name in columns]


def _block_scorer(n: int, decimals: int | None, path: str = "", kind: str = "f4"):
    nothing = pa.table(
        {"user_id": pa.array([], pa.int32()), "book_id": pa.array([], pa.int32()), "prediction": pa.array([], pa.float64()), "rank": pa.array([], pa.int32())}
    )

    def scorer(users: pa.Table, rated: pa.Table) -> pa.Table:
        if not len(users):
            return nothing
        block = users["item_block"][0].as_py()
        packs = [np.frombuffer(ids, np.int32) for (ids,) in _read_items(path, block, ["ids"])]
        if not packs:
            return nothing
        user_ids = users["id"].to_numpy()
        # Slices that do not go beyond a pack.
        sizes = [len(ids) for ids in packs]
        starts = np.concatenate([np.arange(end - size, end, _SLICE) for size, end in zip(sizes, np.cumsum(sizes))])
        cells = cells_by_slice(*_seen_cells(rated, user_ids, np.concatenate(packs)), starts)
        del packs
        search = Search(_vectors(users["features"]), n, decimals)
        for ids, flat in _read_items(path, block, ["ids", "vectors"]):
            ids = np.frombuffer(ids, np.int32)
            vectors = np.frombuffer(flat, kind).reshape(len(ids), -1)
            for at in range(0, len(ids), _SLICE):
                part = vectors[at : at + _SLICE]
                search.take(part, ids[at : at + _SLICE], np.fmax.reduce(_lengths(part), axis=0), *next(cells))
        return found_table(search, user_ids)

    return scorer


def best_items(
    user_factors: DataFrame,
    item_factors: DataFrame,
    n: int,
    seen: DataFrame | None = None,
    decimals: int | None = None,
    users_per_block: int | None = None,
    items_per_block: int | None = None,
) -> DataFrame:
    """(user_id, book_id, prediction, rank) of the ``n`` best items of every user.

    Factors are ``(id, features)``. ``seen`` holds (user_id, book_id) pairs to leave out.
    ``decimals`` rounds the scores before they are compared, so that scores which differ only
    by rounding error count as equal. Blocks of users hold ``USER_BYTES`` of vectors if nothing else is said.
    The items are written when this is called, into the shared folder.
    """
    spark = user_factors.sparkSession
    # Fresh column identities, because both sides may be the same table.
    user_factors, item_factors = (
        side.select(F.col("id").alias("id"), F.col("features").alias("features"))
        for side in (user_factors, item_factors)
    )
    (users, user_rows), (items, _) = block_rows(user_factors, USER_BYTES), block_rows(item_factors)
    # Several pairs of blocks per core where there are users for them, or else items.
    pairs, most = 8 * spark.sparkContext.defaultParallelism, max(1, -(-users // _LEAST_USERS))
    busy = min(-(-pairs // most), -(-items // _LEAST_ITEMS))
    item_blocks = max(1, -(-items // (items_per_block or _MOST_ITEMS)), 0 if items_per_block else busy)
    user_blocks = max(1, -(-users // (users_per_block or user_rows)), min(-(-pairs // item_blocks), most))
    # Fixed, because block pairs are small in bytes and heavy in work: AQE would merge them. Twice as many tasks
    # as pairs, so that few tasks get several of them.
    tasks = 2 * user_blocks * item_blocks

    user_block = _block("id", user_blocks).alias("user_block")
    every_item_block = F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("item_block")
    left = user_factors.select(user_block, every_item_block, "id", "features")
    # What a user has rated travels apart from the features, one row per item block: a set
    # that copies do not add to, and that has at most as many members as the block.
    if seen is None:
        seen = spark.createDataFrame([], "user_id INT, book_id INT")
    rated = (
        seen.select(F.col("user_id").alias("id"), "book_id")
        .dropna()
        .groupBy("id", _block("book_id", item_blocks).alias("item_block"))
        .agg(F.collect_set("book_id").alias("seen"))
    )
    right = rated.select(user_block, "item_block", "id", "seen")
    path = _write_items(item_factors, item_blocks)
    kind = "f4" if item_factors.schema["features"].dataType.elementType.typeName() == "float" else "f8"
    pair = ["user_block", "item_block"]
    scored = (
        left.repartition(tasks, *pair)
        .groupBy(*pair)
        .cogroup(right.repartition(tasks, *pair).groupBy(*pair))
        .applyInArrow(_block_scorer(n, decimals, path, kind), _OUT)
    )
    if item_blocks == 1:
        return scored
    return rank_per_user(scored.drop("rank"), n)


def rank_per_user(recs: DataFrame, n: int) -> DataFrame:
    """Keep and number the ``n`` best recommendations per user.

    The rank filter lets Spark drop all but ``n`` rows per user before the shuffle.
    """
    best_first = Window.partitionBy("user_id").orderBy(F.desc("prediction"), "book_id")
    return recs.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= n)
