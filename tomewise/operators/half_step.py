"""Half a step of ALS for all keys of one side, block by block.

The ratings of a side are written down once per block of keys, as arrays. A half step gives every block to a task, which
reads the other side's factors from the shared folder, keeps those that its ratings need and solves all its keys. The new
factors are written once, whatever the number of blocks; shuffling them would send each to every block it is needed in.

For a key with n ratings r of things with factors Y, the factors x >= 0 that minimise |Yx - r|^2 + reg n |x|^2 are
max(0, Y'e) / (reg n), where e = r - Yx. With fewer ratings than factors e is the smaller unknown, else x is. Either is
found by solving for the entries that are free, for many keys at once, until the same entries are free again.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.session import fresh_dir

# Send the functions themselves, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of factors in one row, and of doubles that are solved together.
PACK, TOGETHER = 1 << 20, 1 << 21
# Rounds until keys whose free entries still change are solved one by one, by pivoting that ends.
ROUNDS = 30
# The block of factors that were not solved in blocks.
_ANY = -1
_INT = pa.int32()
_KINDS = {"ids": np.int32, "ends": np.int64, "others": np.int32, "at": np.int32, "ratings": np.float32}
# Ratings to compare with are as they came.
_COMPARED = _KINDS | {"ratings": np.float64}
_BLOCK = "block INT, " + ", ".join(f"{name} BINARY" for name in _KINDS)
# Pairs that are scored together.
_PAIRS = 1 << 16
_PACKED = "block INT, ids BINARY, vectors BINARY"


def _row(block: int, cells: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([block], _INT), *(pa.array([cell.tobytes()], pa.binary()) for cell in cells)]
    return pa.RecordBatch.from_arrays(columns, names=["block", *names])


def _block(kinds: dict[str, type]):
    """Rows (id, other, rating, block) of one block, in order: one row of arrays, if there are any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[batch.column(i).to_numpy() for i in range(4)] for batch in batches if len(batch)]
        if not read:
            return
        keys, others, ratings, block = (np.concatenate(c) for c in zip(*read))
        last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
        different, at = np.unique(others, return_inverse=True)
        arrays = dict(ids=keys[last], ends=last + 1, others=different, at=at, ratings=ratings)
        yield _row(int(block[0]), [arrays[name].astype(kind) for name, kind in kinds.items()], list(kinds))

    return work


def _placed(ratings: DataFrame, key: str, other: str, n: int, kind: str) -> DataFrame:
    rows = ratings.select(
        F.col(key).cast("int").alias("id"), F.col(other).cast("int").alias("other"), F.col("rating").cast(kind).alias("rating")
    )
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartitionById(n, "block")
    # Also by rating, so that sums do not depend on how equal pairs arrived.
    return placed.sortWithinPartitions("id", "other", "rating")


def blocks(ratings: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """The ratings in ``n`` blocks of keys, a row each, persisted; all ratings of a key are in one block."""
    return _placed(ratings, key, other, n, "float").mapInArrow(_block(_KINDS), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)


def compared(ratings: DataFrame, n: int) -> DataFrame:
    """Ratings that :func:`errors` compares with predictions, in the ``n`` blocks that their users are solved in, persisted."""
    known = ratings.dropna(subset=["user_id", "book_id", "rating"])
    placed = _placed(known, "user_id", "book_id", n, "double")
    return placed.mapInArrow(_block(_COMPARED), _BLOCK).persist(StorageLevel.MEMORY_AND_DISK)


def _packs(block: int, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, PACK // (4 * max(1, vectors.shape[1])))
    for a in range(0, len(ids), step):
        cells = [ids[a : a + step].astype(np.int32), vectors[a : a + step].astype(np.float32)]
        yield _row(block, cells, ["ids", "vectors"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield from _packs(_ANY, batch.column(0).to_numpy(), vectors.reshape(len(batch), -1))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, vectors in zip(batch.column(1), batch.column(2)):
            ids, flat = np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(vectors.as_buffer(), np.float32)
            ends = np.arange(len(ids) + 1, dtype=np.int32) * (len(flat) // max(1, len(ids)))
            features = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids), features], names=["id", "features"])


def written(packed: DataFrame) -> str:
    """The folder that packed factors are written to, for the tasks of the next half step."""
    path = fresh_dir(packed.sparkSession, "factors")
    packed.write.option("compression", "uncompressed").parquet(path)
    return path


def pack(factors: DataFrame) -> DataFrame:
    """``factors (id, features)`` as rows that hold many of them."""
    return factors.select("id", "features").mapInArrow(_packed, _PACKED)


def unpack(packed: DataFrame) -> DataFrame:
    return packed.mapInArrow(_unpacked, "id INT, features ARRAY<FLOAT>")


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    """Hadoop names local folders file:/x, Arrow file:///x."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _factors_of(wanted: np.ndarray, path: str, rank: int, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The factors of ``wanted``, in that order, and which of them there are. A pack is read at a time; with a
    ``block`` only row groups that may hold some of it."""
    found, there = np.zeros((len(wanted), rank), np.float32), np.zeros(len(wanted), bool)
    fs, folder = _folder(path)
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if not info.base_name.endswith(".parquet") or info.base_name.startswith((".", "_")):
            continue
        with fs.open_input_file(info.path) as file:
            table = pq.ParquetFile(file)
            groups = [g for g in range(table.num_row_groups) if _may_hold(table.metadata.row_group(g).column(0).statistics, block)]
            for batch in table.iter_batches(batch_size=8, row_groups=groups, columns=["ids", "vectors"]):
                for ids, vectors in zip(batch.column("ids"), batch.column("vectors")):
                    ids = np.frombuffer(ids.as_buffer(), np.int32)
                    place = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
                    hit = wanted[place] == ids
                    found[place[hit]] = np.frombuffer(vectors.as_buffer(), np.float32).reshape(len(ids), rank)[hit]
                    there[place[hit]] = True
    return found, there


def _may_hold(known: pq.Statistics | None, block: int | None) -> bool:
    return block is None or known is None or not known.has_min_max or known.min <= block <= known.max


def non_negative(gram: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The x >= 0 with the least x'Gx/2 - s'x, for a positive definite G, by pivoting blocks of entries between zero
    and free. Where that does not improve, single entries are pivoted, which ends for any such G."""
    free = np.ones(len(side), bool)
    fewest, patience = len(side) + 1, 3
    while True:
        x = np.zeros(len(side))
        x[free] = np.linalg.solve(gram[np.ix_(free, free)], side[free])
        slope = gram @ x - side
        slack = 1e-12 * max(1.0, np.abs(side).max(initial=0.0))
        wrong = np.flatnonzero(np.where(free, x < 0, slope < -slack))
        if not len(wrong):
            return x
        if len(wrong) < fewest:
            fewest, patience = len(wrong), 3
        elif patience:
            patience -= 1
        else:
            wrong = wrong[-1:]
        free[wrong] = ~free[wrong]


def _by_errors(y: np.ndarray, r: np.ndarray, penalty: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of many keys, each with ratings r of y, by way of their errors; and which keys are left unsolved."""
    x, left, diagonal = np.zeros(free.shape), np.arange(len(y)), np.arange(y.shape[1])
    for _ in range(ROUNDS):
        turned = y.transpose(0, 2, 1)
        system = (y * (free / penalty[:, None])[:, None, :]) @ turned
        system[:, diagonal, diagonal] += 1
        pull = (turned @ np.linalg.solve(system, r[:, :, None]))[:, :, 0]
        positive = pull > 0
        done = (positive == free).all(1)
        x[left[done]] = np.where(positive[done], pull[done], 0) / penalty[done, None]
        more = ~done
        left, y, r, penalty, free = left[more], y[more], r[more], penalty[more], positive[more]
        if not len(left):
            break
    return x, left


def _by_factors(gram: np.ndarray, side: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the sums of outer products, penalty included, and of vectors times ratings."""
    x, left, diagonal = np.zeros(side.shape), np.arange(len(side)), np.arange(side.shape[1])
    for _ in range(ROUNDS):
        system = gram * free[:, None, :] * free[:, :, None]
        system[:, diagonal, diagonal] += ~free
        at = np.linalg.solve(system, (side * free)[:, :, None])
        slope, at = (gram @ at)[:, :, 0] - side, at[:, :, 0]
        now = np.where(free, at > 0, slope < 0)
        done = (now == free).all(1)
        x[left[done]] = np.where(free[done], at[done], 0)
        more = ~done
        left, gram, side, free = left[more], gram[more], side[more], now[more]
        if not len(left):
            break
    return x, left


def _one(y: np.ndarray, r: np.ndarray, penalty: float) -> np.ndarray:
    """Factors of one key, whatever its number of ratings; ``y`` are floats that are widened a part at a time."""
    rank = y.shape[1]
    gram, side, step = penalty * np.eye(rank), np.zeros(rank), max(1, TOGETHER // (8 * rank))
    for a in range(0, len(y), step):
        part = y[a : a + step].astype(np.float64)
        gram += part.T @ part
        side += part.T @ r[a : a + step].astype(np.float64)
    return non_negative(gram, side)


def solve(
    ends: np.ndarray, at: np.ndarray, ratings: np.ndarray, vectors: np.ndarray, reg: float, free: np.ndarray | None = None
) -> np.ndarray:
    """Factors of all keys of a block: key i has the ratings ``ends[i - 1]`` up to ``ends[i]``, of ``vectors[at]``.
    ``free`` is a guess which of them are above zero; the result does not depend on it."""
    rank = vectors.shape[1]
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    out = np.zeros((len(ends), rank), np.float32)
    order = np.argsort(sizes, kind="stable")
    ordered, first = sizes[order], 0
    while first < len(order):
        # Keys with about as many ratings are solved together, all padded to the most among them.
        n = int(ordered[first])
        room = max(1, TOGETHER // (8 * rank * max(n, rank if n > rank else 1)))
        end = int(np.searchsorted(ordered, n + n // 8, side="right"))
        some = order[first : min(end, first + room)]
        first += len(some)
        most = int(sizes[some[-1]])
        if most * rank * 8 > TOGETHER:
            for key in some:
                span = slice(starts[key], ends[key])
                out[key] = _one(vectors[at[span]], ratings[span], reg * sizes[key])
            continue
        place = starts[some, None] + np.arange(most)
        filled = place < ends[some, None]
        place = np.where(filled, place, 0)
        y = vectors[at[place]].astype(np.float64)
        y[~filled] = 0
        r = ratings[place].astype(np.float64) * filled
        penalty = reg * sizes[some]
        guess = np.ones((len(some), rank), bool) if free is None else free[some]
        if most > rank:
            turned = y.transpose(0, 2, 1)
            gram = turned @ y
            gram[:, np.arange(rank), np.arange(rank)] += penalty[:, None]
            x, left = _by_factors(gram, (turned @ r[:, :, None])[:, :, 0], guess)
        else:
            x, left = _by_errors(y, r, penalty, guess)
        for i in left:
            x[i] = _one(y[i], r[i], penalty[i])
        x[np.isnan(r).any(1)] = np.nan
        out[some] = x
    return out


def _known(block: dict[str, np.ndarray], there: np.ndarray) -> dict[str, np.ndarray]:
    """The block without ratings of what has no factors, and without keys that have no others."""
    kept = there[block["at"]]
    ends = np.concatenate([[0], np.cumsum(kept)])[block["ends"]]
    some = np.diff(ends, prepend=0) > 0
    return block | {"ids": block["ids"][some], "ends": ends[some], "at": block["at"][kept], "ratings": block["ratings"][kept]}


def _read(batch: pa.RecordBatch, row: int, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, (name, kind) in enumerate(kinds.items(), 1)}


def _solved(path: str, rank: int, reg: float, before: str | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number in enumerate(batch.column(0).to_pylist()):
                block = _read(batch, row, _KINDS)
                vectors, there = _factors_of(block["others"], path, rank)
                if not there.all():
                    block = _known(block, there)
                free = None if before is None else _factors_of(block["ids"], before, rank, number)[0] > 0
                factors = solve(block["ends"], block["at"], block["ratings"], vectors, reg, free)
                yield from _packs(number, block["ids"], factors)

    return work


def _scored(users: str, books: str, rank: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number in enumerate(batch.column(0).to_pylist()):
                block = _read(batch, row, _COMPARED)
                of_users, user_there = _factors_of(block["ids"], users, rank, number)
                of_books, book_there = _factors_of(block["others"], books, rank)
                user = np.repeat(np.arange(len(block["ids"])), np.diff(block["ends"], prepend=0))
                total, n = 0.0, 0
                for a in range(0, len(user), _PAIRS):
                    u, b, rating = user[a : a + _PAIRS], block["at"][a : a + _PAIRS], block["ratings"][a : a + _PAIRS]
                    known = user_there[u] & book_there[b]
                    x, y = of_users[u[known]].T.copy(), of_books[b[known]].T.copy()
                    # As a model predicts: floats, one factor after another.
                    prediction = np.zeros(x.shape[1], np.float32)
                    for i in range(rank):
                        prediction += x[i] * y[i]
                    error = (prediction - rating[known])[~np.isnan(prediction)]
                    total, n = total + float(error @ error), n + len(error)
                yield pa.RecordBatch.from_arrays([pa.array([number], _INT), pa.array([total]), pa.array([n], pa.int64())], names=["block", "total", "scored"])

    return work


def errors(side: DataFrame, users: str, books: str, rank: int) -> DataFrame:
    """Per block of :func:`compared` ratings, the squared errors of their predictions by the packed factors at ``users`` and
    ``books`` added up, and their number; what has no factors is not scored. The users were solved in the same blocks."""
    return side.mapInArrow(_scored(users, books, rank), "block INT, total DOUBLE, scored BIGINT")


def half_step(side: DataFrame, path: str, rank: int, reg: float, before: str | None = None) -> DataFrame:
    """Packed factors of all keys of the :func:`blocks` ``side``, against the other side's, written at ``path``.

    Ratings of what has no factors there do not count. ``before`` is where the half step before it was written: most
    entries that were above zero stay so, which saves rounds."""
    return side.mapInArrow(_solved(path, rank, reg, before), _PACKED)
