"""Language identification by prediction by partial matching (operator 12).

Each language has a context tree over bytes: how often each byte followed each context of up to ``ORDER`` bytes. A byte
is coded in its longest context that the language has seen; if it never followed there, an escape is coded and the next
shorter context is asked. With n(c) bytes seen behind a context c, of which n(c, b) were b and d(c) were different,

    p(b | c) = n(c, b) / (n(c) + d(c)),    p(escape | c) = d(c) / (n(c) + d(c)),

a context that was never seen costs nothing, and behind the empty context all 256 bytes are alike. Trees do not change
while a text is scored, so its code length in a language is exactly the sum over its bytes, and the language with
the shortest code is predicted. The score is its posterior probability if all languages are equally likely at first.

As the counts are frozen, the code lengths of all (context, byte) strings that some language has seen are worked out
once, by length of string, and looked up in a hash table of arrays, all languages at once; only strings that no language
has seen take the escape and ask one length less. A text begins behind ``ORDER`` zero bytes. Whole texts are scored.

Fit: at most ``PER_LANG`` documents of each of the ``LANGS`` most frequent languages, the first by a hash of their id, and
of these the first until ``LANG_BYTES`` bytes are met, each whole; Spark counts their strings. So the model is bounded, and
is what is broadcast. Labels come from the documents that are not held out; a document without id, text or language
teaches nothing; rows that repeat an id count once, with the least language and text of it.

A text that is null or has no letter (Unicode category L) is ``und`` with score 0, as is every text where there was
nothing to learn from. Of equally short codes the first language by name wins. Ties, repeated rows and extra columns
change nothing, since each text is scored by itself.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tomewise.llm.common import cut, map_batches, slices, text_bytes
from tomewise.llm.labelled import held_out

ORDER = 3
LANGS, PER_LANG, LANG_BYTES = 200, 400, 1 << 20
UNKNOWN = "und"
LETTER = r"\p{L}"
_TABLE_LOAD = 4
_SPREAD = np.uint32(0x9E3779B1)
_EMPTY = np.int32(-1)


def strings(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each byte of each text with the ``order`` bytes before it, as one number; zeros stand before a text."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    code = data.astype(np.uint32)
    for back in range(1, order + 1):
        earlier = np.zeros(len(data), np.uint32)
        earlier[back:] = data[:-back]
        code |= np.where(place >= back, earlier, np.uint32(0)) << np.uint32(8 * back)
    return code


class Index:
    """Rows of distinct 32-bit keys, in a hash table with linear probing that arrays walk together."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint32(32 - max(4, math.ceil(math.log2(_TABLE_LOAD * max(1, len(keys))))))
        size = 1 << (32 - int(self.shift))
        self.keys, self.row = np.zeros(size, np.uint32), np.full(size, _EMPTY, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            slots, first = np.unique(at, return_index=True)
            placed = first[self.row[slots] == _EMPTY]
            self.keys[at[placed]], self.row[at[placed]] = keys[left[placed]], left[placed]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is not there."""
        at = self._slot(keys)
        row = self.row[at]
        ask = np.flatnonzero((row != _EMPTY) & (self.keys[at] != keys))
        at = at[ask]
        while len(ask):
            at = (at + 1) % len(self.row)
            found = self.row[at]
            row[ask] = found
            more = (found != _EMPTY) & (self.keys[at] != keys[ask])
            ask, at = ask[more], at[more]
        return row


@dataclass
class Level:
    """Strings of one length that some language has seen, with their code lengths in bits by language, and contexts
    of one byte less with the cost of an escape there."""

    seen: Index
    bits: np.ndarray
    contexts: Index
    escape: np.ndarray


@dataclass
class Model:
    """Levels from the longest strings to single bytes; the last answer is eight bits."""

    langs: list[str]
    levels: list[Level]

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code lengths by string and language, of numbers that hold a byte behind ``ORDER`` others."""
        out = np.empty((len(code), len(self.langs)), np.float32)
        self._fill(out, np.arange(len(code)), code, 0, 0.0)
        return out

    def _fill(self, out: np.ndarray, at: np.ndarray, code: np.ndarray, level: int, before) -> None:
        if level == len(self.levels):
            out[at] = before + np.float32(8)
            return
        here = self.levels[level]
        length = len(self.levels) - level
        key = code if length == 4 else code & np.uint32((1 << 8 * length) - 1)
        row = here.seen.find(key)
        known = row >= 0
        if known.all():
            out[at] = before + here.bits[row]
            return
        chosen = np.flatnonzero(known)
        out[at[chosen]] = (before if np.isscalar(before) else before[chosen]) + here.bits[row[chosen]]
        rest = np.flatnonzero(~known)
        context = here.contexts.find(key[rest] >> np.uint32(8))
        escape = np.where((context >= 0)[:, None], here.escape[context], np.float32(0))
        self._fill(out, at[rest], code[rest], level + 1, (before if np.isscalar(before) else before[rest]) + escape)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code lengths in bits by text and language."""
        out = np.zeros((len(texts), len(self.langs)))
        for at, part in slices(texts):
            data, offsets = text_bytes(part)
            # Long texts in pieces, so that memory does not follow the longest.
            code = strings(data, offsets)
            size = np.diff(offsets)
            of = np.repeat(np.arange(len(size)), size)
            for a in range(0, len(code), 1 << 18):
                bits, doc = self.bits(code[a : a + (1 << 18)]), of[a : a + (1 << 18)]
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                out[at + doc[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out


def model_of(langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """The trees from counts ``n`` of strings of ``ORDER`` + 1 bytes in each language (its number in ``langs``)."""
    size = len(langs)
    levels: list[Level] = []
    shorter = None
    for length in range(1, ORDER + 2):
        key = (code & np.uint32((1 << 8 * length) - 1)) if length < 4 else code
        keys, row = np.unique(key, return_inverse=True)
        counts = np.zeros((len(keys), size))
        np.add.at(counts, (row, lang), n)
        contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
        total, different = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, of, counts)
        np.add.at(different, of, counts > 0)
        seen = total > 0
        all_ = np.where(seen, total + different, 1)
        # Nothing is paid where a context was never seen; behind one that was, something was different.
        escape = np.where(seen, -np.log2(np.where(seen, different, 1) / all_), 0.0)
        below = np.full((len(keys), size), 8.0)
        if shorter is not None:
            below = shorter[1][np.searchsorted(shorter[0], keys & np.uint32((1 << 8 * (length - 1)) - 1))]
        here = counts > 0
        bits = np.where(here, -np.log2(np.where(here, counts, 1) / all_[of]), escape[of] + below)
        levels.insert(0, Level(Index(keys), bits.astype(np.float32), Index(contexts), escape.astype(np.float32)))
        shorter = keys, bits
    return Model(langs, levels)


def _sample(docs: DataFrame, fold: tuple[int, int]) -> DataFrame:
    """(lang, text) of the documents that teach."""
    known = docs.filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", *fold)
    ).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = counted.orderBy(F.desc("n"), "lang").limit(LANGS).select("lang")
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).join(F.broadcast(langs), "lang", "left_semi")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = ids.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= PER_LANG).drop("nth")
    # One row an id, however often it is repeated: at most LANGS x PER_LANG rows from here on.
    texts = known.join(F.broadcast(drawn), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    texts = cut(texts)
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(F.octet_length("text").cast("long")).over(before)
    return texts.withColumn("before", F.coalesce(size, F.lit(0))).filter(F.col("before") < LANG_BYTES).select("lang", "text")


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at, part in slices(batch.column(1)):
        data, offsets = text_bytes(part)
        lang = batch.column(0).slice(at, len(part)).dictionary_encode()
        of = np.repeat(lang.indices.to_numpy(), np.diff(offsets)).astype(np.uint64)
        both, n = np.unique(of << np.uint64(32) | strings(data, offsets), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array((both >> np.uint64(32)).astype(np.int64))),
                pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                pa.array(n.astype(np.int64)),
            ],
            names=["lang", "code", "n"],
        )


def fit(docs: DataFrame, fold: tuple[int, int]) -> Model | None:
    """A model from ``docs (doc_id, text, lang)`` without the held-out ``fold`` (parts, part); None if nothing teaches."""
    counted = map_batches(_sample(docs, fold), _count, "lang STRING, code BIGINT, n BIGINT")
    counts = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not len(counts):
        return None
    lang = counts["lang"].combine_chunks().dictionary_encode()
    lang = pa.concat_arrays(lang.chunks) if isinstance(lang, pa.ChunkedArray) else lang
    names = lang.dictionary.to_pylist()
    langs = sorted(names)
    number = np.array([langs.index(x) for x in names])[lang.indices.to_numpy()]
    return model_of(langs, number, counts["code"].to_numpy().astype(np.uint32), counts["n"].to_numpy())


def predict(model: Model | None, text: str | Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    text = F.col(text) if isinstance(text, str) else text
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown
    # As bytes that hold the classes by value too. Each Python worker unpacks them once.
    sent = SparkSession.active().sparkContext.broadcast(cloudpickle.dumps(model))
    unpacked = []

    @arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        if not unpacked:
            unpacked.append(cloudpickle.loads(sent.value))
        mine = unpacked[0]
        bits = mine.lengths(texts)
        best = bits.argmin(axis=1) if len(bits) else np.empty(0, int)
        over = bits - bits.min(axis=1, keepdims=True) if len(bits) else bits
        score = 1 / np.exp2(-np.minimum(over, 1000)).sum(axis=1)
        names = pa.array(mine.langs, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score)], names=["lang_pred", "score"])

    return F.when(F.coalesce(text.rlike(LETTER), F.lit(False)), predicted(text)).otherwise(unknown)

