"""What several operators share: tables, words as arrays of 64-bit numbers, Arrow batches."""

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.session import cut, fresh_dir, shared_dir

# Words are what stands between these bytes: blank, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

SLICE_BYTES = 1 << 18
FILTER_WORDS = 1 << 20
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``cut``, with the place of the table, for ``drop_table``."""
    spark = df.sparkSession
    path = fresh_dir(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next happens to collect
    its garbage. What follows has to read written tables only."""
    gc.collect()
    spark._jvm.System.gc()


def _filter_bits(key: Column) -> Column:
    """Three bits of a 64-bit word for a key."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def split_by_ids(df: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` as rows whose ``column`` is surely not among ``ids`` (one column), nulls too, and the others, most of which are.

    The ids are a Bloom filter of at most ``FILTER_WORDS`` words, about ten bits an id where that is enough, so what is
    broadcast is bounded. With more ids more rows are in doubt, and none is lost: the others still have to be joined. So
    rows that a join would only drop or let through do not move."""
    (name,) = ids.columns
    key = F.col(name).cast("long")
    n = ids.count()
    words = min(FILTER_WORDS, 1 << max(6, (max(1, n) * 10 // 64).bit_length()))
    word_of = lambda k: F.pmod(F.xxhash64(k), F.lit(words))
    filter_ = ids.filter(key.isNotNull()).groupBy(word_of(key).alias("_word")).agg(F.bit_or(_filter_bits(key)).alias("_bits"))
    mine = F.col(column).cast("long")
    rows = df.select(F.struct("*").alias("_row"), F.when(mine.isNotNull(), word_of(mine)).alias("_word"), _filter_bits(mine).alias("_mine"))
    marked = rows.join(F.broadcast(cut(filter_)), "_word", "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mine")) == F.col("_mine"), F.lit(False))
    return marked.filter(~maybe).select("_row.*"), marked.filter(maybe).select("_row.*")


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _letters(seed: int) -> np.ndarray:
    """A random number for each byte at each of the first 64 places of a word."""
    return mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(seed))


# Odd constants of no meaning; two of them, where 64 bits are too few to tell words apart.
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_LETTERS = {seed: _letters(seed) for seed in SEEDS}


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``texts`` in runs of about ``size`` bytes, each with its first row; null becomes empty."""
    texts = texts.fill_null("")
    lengths = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, texts.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each text begins."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(
    texts: pa.Array, lower: bool = False, seeds: tuple[int, ...] = SEEDS[:1]
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """First word of each text (one more at the end), the words' numbers by seed, and where
    each word begins and ends in the returned bytes."""
    data, offsets = text_bytes(texts)
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(begin, offsets)
    letters = data[inside]
    if lower:
        letters = _LOWER[letters]
    lengths = end - begin
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    numbers = []
    for seed in seeds:
        value = _LETTERS[seed][((place & 63) << 8) | letters]
        if len(place) and place.max() > 63:
            value *= mix((place >> 6).astype(np.uint64)) | np.uint64(1)
        total = np.add.reduceat(value, at) if len(at) else np.empty(0, np.uint64)
        numbers.append(mix(total + lengths.astype(np.uint64)))
    return first, numbers, begin, end, data


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``work`` on every Arrow batch of ``df``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(each, schema)


def read_texts(spark: SparkSession) -> None:
    """Let this session read and send whole texts in batches of few rows: what a scan and an Arrow batch hold at once follows
    the number of their rows, which is made for narrow ones."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", TEXT_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2 * TEXT_ROWS)


def binaries(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of ``flat`` as binary values."""
    flat = np.ascontiguousarray(flat)
    at = np.asarray(offsets, np.int64) * flat.itemsize
    if at[-1] >= 1 << 31:
        raise ValueError("a batch holds more than 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(
        pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)]
    )


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), pa.array(flat))

