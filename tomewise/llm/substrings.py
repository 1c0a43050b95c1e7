"""Removal of repeated word windows by recompression (operator 8).

Every word covered by a window of ``window`` consecutive words of a document whose words also start anywhere else
goes, be it in the same document. Windows are judged on the input.

Recompression names words and shortens a text round by round: first every run of one symbol becomes a symbol
named after the symbol and the run's length, then every pair of a left and a right symbol becomes a symbol named after the
two, where a bit of the symbol's name, new in every round, decides whether it is left or right. Names are hashes
of what they stand for, so that they are the same in all documents and no round needs a shuffle. A symbol hence depends
on the words below it and on a few around it, its context; wherever the same words stand around it again, it is there
again. Steps:

1. Recompress every document. Each window takes as its anchor a symbol whose context lies inside the window: one of the longest,
   and the least name among those. Equal windows have equal anchors at the same place. Neighbouring windows
   with one anchor are a span; its name and a fingerprint of all its words go into a table.
2. Spark counts names. A span whose name is the only one of its kind has no repeated window. A span that agrees with another
   in its fingerprint too is repeated as a whole.
3. Where spans of one name differ, as at the edges of repeats, the document of one span of each kind comes again, and the
   spans' windows are compared by 128-bit fingerprints, one by one. Windows without an anchor (inside long runs) are
   spans of their own, named after all their words.

Equality of windows is equality of two independent 64-bit hashes over two independent 64-bit hashes of words.

A null or empty text has no words and keeps nothing; a document shorter than the window keeps all words.
Rows that repeat a document are copies like any other, also with the same doc_id, and a null doc_id is no obstacle: rows
are told apart by a number given when they are first written. Other columns are kept.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import SEEDS, cut, cut_at, drop_table, map_batches, mix, release, slices, words_of

WINDOW = 35
# Beyond this round symbols are longer than a window allows.
ROUNDS = 10
LONG = 5
_ROUND = np.uint64(0x9FB21C651E98DF25)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _join(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """The name of a symbol made of two numbers."""
    return mix(mix(a + np.uint64(kind)) * _ROUND + b)


def recompress(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS, longest: int = WINDOW):
    """Yield, per round, (name, begin, end, low, high) of its new symbols: words [begin, end) and the words [low, high)
    they depend on. ``doc`` is the document of each word; nothing crosses documents.

    A pair depends on its two symbols alone, since neither could go together with another. A symbol that stays
    alone depends on the symbol on the side where its partner would be, and on all that this depends on. A run, or a
    symbol that is none, depends on the word on either side; where that is what another of the run would have
    there, on all that the neighbour depends on. What depends on the end of a document reaches beyond it, so that no
    window holds it.
    """
    name, of = words, doc
    begin = np.arange(len(words))
    end, low, high = begin + 1, begin, begin + 1
    first, last = np.searchsorted(doc, doc, "left"), np.searchsorted(doc, doc, "right")
    for level in range(rounds):
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (of[1:] != of[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(name)))
        name = np.where(size > 1, _join(name[head], size.astype(np.uint64), 1), name[head])
        tail, run = head + size - 1, size > 1
        if not len(head):
            return
        low, high = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
        of, begin, end = of[head], begin[head], end[tail]
        # A word beside it that differs from its own at that place tells that no more of the run is there; else
        # all tells that the neighbour depends on.
        left, right = np.maximum(begin - 1, 0), np.minimum(end, len(words) - 1)
        differs_left = (words[left] != words[end - 1]) | (begin == first[begin])
        differs_right = (words[right] != words[begin]) | (end == last[begin])
        low_left, high_left = np.append(low[:1], low[:-1]), np.append(high[:1], high[:-1])
        low_right, high_right = np.append(low[1:], low[-1:]), np.append(high[1:], high[-1:])
        own_low, own_high = low, high
        low = np.minimum(own_low, np.where(differs_left, begin - 1, low_left))
        low = np.where(differs_right, low, np.minimum(low, low_right))
        high = np.maximum(own_high, np.where(differs_right, end + 1, high_right))
        high = np.where(differs_left, high, np.maximum(high, high_left))

        is_right = (mix(name ^ np.uint64((2 * level + 1) * int(_ROUND) & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[1:] = ~is_right[:-1] & is_right[1:] & (of[1:] == of[:-1])
        head = np.flatnonzero(~joins)
        size = np.diff(np.append(head, len(name)))
        made = (size > 1) | run[head]
        tail = head + size - 1
        # The neighbour that a symbol would have gone together with.
        before, after = np.maximum(head - 1, 0), np.minimum(head + 1, len(name) - 1)
        has_before = (head > 0) & (of[before] == of[head])
        has_after = (head < len(name) - 1) & (of[after] == of[head])
        low_beside = np.where(has_before, low[before], first[begin[head]] - 1)
        high_beside = np.where(has_after, high[after], last[begin[head]] + 1)
        alone_right, alone_left = (size == 1) & is_right[head], (size == 1) & ~is_right[head]
        new_low = np.minimum(low[head], low[tail])
        new_high = np.maximum(high[head], high[tail])
        inner_high = np.where(has_before, high[before], new_high)
        inner_low = np.where(has_after, low[after], new_low)
        low = np.where(alone_right, np.minimum(new_low, low_beside), np.where(alone_left, np.minimum(new_low, inner_low), new_low))
        high = np.where(alone_left, np.maximum(new_high, high_beside), np.where(alone_right, np.maximum(new_high, inner_high), new_high))
        name = np.where(size > 1, _join(name[head], name[tail], 2 + level), name[head])
        of, begin, end = of[head], begin[head], end[tail]
        # A symbol that was there before depends on no more than it did then.
        yield name[made], begin[made], end[made], low[made], high[made]
        if not len(name) or (high - low).min() > longest:
            return


class _Powers:
    """Powers of the bases and of their inverses modulo 2^64, as many as were asked for so far."""

    def __init__(self):
        self.tables = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]

    def get(self, n: int):
        if len(self.tables[0][0]) < n:
            self.tables = []
            for base in _BASES:
                pair = []
                for b in (int(base), pow(int(base), -1, 1 << 64)):
                    steps = np.full(2 * n, np.uint64(b))
                    steps[0] = 1
                    pair.append(np.cumprod(steps, dtype=np.uint64))
                self.tables.append(tuple(pair))
        return self.tables


_POWERS = _Powers()


def fingerprints(words: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A number for each run of words [begin, end), equal for equal runs."""
    up, down = _POWERS.get(len(words) + 1)[base]
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def anchors(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word at which a window begins: that word, and the name and first word of the window's
    anchor (name 0 and -1 without one)."""
    n = len(words)
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :]) if n >= window else np.empty(0, np.int64)
    if not len(starts):
        return starts, np.empty(0, np.uint64), starts
    parts = [
        [a[fit] for a in (name, begin, end, low, high)]
        for name, begin, end, low, high in recompress(words, doc, longest=window)
        for fit in [(high - low <= window) & (end - begin >= 2)]
    ]
    name, begin, end, low, high = (np.concatenate([p[i] for p in parts]) for i in range(5))
    # The longest symbol up to ``LONG`` words, of these the least name, of these the first: painted last. That
    # lengths beyond do not count makes an anchor last for more windows.
    rank = (np.minimum(end - begin, LONG).astype(np.uint64) << np.uint64(58)) | (~name >> np.uint64(6))
    by_place = np.argsort(begin, kind="stable")[::-1]
    order = by_place[np.argsort(rank[by_place], kind="stable")]
    name, begin, low, high = name[order], begin[order], low[order], high[order]
    from_, to = np.maximum(high - window, 0), low + 1
    count = np.maximum(to - from_, 0)
    best = np.full(n + 1, -1)
    symbol = np.repeat(np.arange(len(name)), count)
    at = from_[symbol] + np.arange(len(symbol)) - np.repeat(np.cumsum(count) - count, count)
    best[np.minimum(at, n)] = symbol
    best = best[starts]
    found = best >= 0
    return starts, np.where(found, name[best], np.uint64(0)), np.where(found, begin[best], -1)


SPANS = "rid BIGINT, name BIGINT, print BIGINT, begin INT, windows INT"


def _span_finder(window: int):
    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, texts in slices(batch.column(1)):
            first, (words,), *_ = words_of(texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(first))
            starts, name, anchor = anchors(words, doc, window)
            if not len(starts):
                continue
            # Windows in a row with one anchor; windows without one stay single.
            new = np.ones(len(starts), bool)
            new[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (name[1:] != name[:-1]) | (anchor[1:] < 0)
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(starts)))
            begin, end = starts[head], starts[head] + count - 1 + window
            print_ = fingerprints(words, begin, end, 0)
            label = np.where(anchor[head] < 0, print_, name[head])
            print_ = _join(print_, np.where(anchor[head] < 0, 0, anchor[head] - begin).astype(np.uint64), 0)
            rid = batch.column(0).slice(at, len(texts)).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rid[doc[begin]]),
                    pa.array(label.view(np.int64)),
                    pa.array(print_.view(np.int64)),
                    pa.array((begin - first[doc[begin]]).astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ],
                names=["rid", "name", "print", "begin", "windows"],
            )

    return find


def _packed(texts: pa.Array) -> pa.Array:
    """Texts, compressed for the way through a shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack(t.as_buffer()) for t in texts.fill_null("").cast(pa.large_binary())], pa.binary())


def _unpacked(packed: list[bytes]) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(p) for p in packed]


def _window_printer(window: int):
    """The windows of chosen spans: two fingerprints, the row and the first word."""

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            texts = pa.array(_unpacked(part.column(1).to_pylist()), pa.binary()).cast(pa.string())
            first, (one, two), *_ = words_of(texts, seeds=SEEDS)
            spans = part.column(2)
            of = np.repeat(np.arange(len(part)), pa.compute.list_value_length(spans).to_numpy(zero_copy_only=False))
            flat = spans.flatten()
            begin, count = flat.field("begin").to_numpy(), flat.field("windows").to_numpy()
            row = np.repeat(of, count)
            at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            word = first[row] + at
            f = [fingerprints(w, word, word + window, b) for b, w in enumerate((one, two))]
            rid = part.column(0).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array(rid), pa.array(at.astype(np.int32))],
                names=["f1", "f2", "rid", "begin"],
            )

    return windows


def repeated_runs(rows: DataFrame, window: int) -> DataFrame:
    """(rid, runs array<struct<begin, words>>): which words of each row of ``rows (rid, text)`` are covered."""
    from pyspark.sql.functions import arrow_udf

    spark = rows.sparkSession
    spans, spans_path = cut_at(map_batches(rows, _span_finder(window), SPANS))
    # Written down, so that both sides of the join are plain shuffles and a hot name can be split.
    names = cut(spans.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("name"))
    shared = cut(spans.join(names, "name"))
    # Most spans are the only ones of their name, and nothing reads them again.
    drop_table(spark, spans_path)
    release(spark)
    # Of spans that agree in all their words one stands for all, and its windows are compared with those of
    # spans that only share the name.
    kinds = cut(
        shared.groupBy("name", "print").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "begin", "windows")).alias("span")
        )
    )
    agree = kinds.filter(F.col("n") > 1).select("name", "print")
    whole = shared.join(agree, ["name", "print"], "left_semi").select(
        "rid", "begin", (F.col("windows") + (window - 1)).alias("words")
    )
    mixed = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > 1).select("name")
    chosen = kinds.join(mixed, "name", "left_semi").select("span.*")
    chosen = chosen.groupBy("rid").agg(F.collect_set(F.struct("begin", "windows")).alias("spans"))
    pack = arrow_udf(_packed, "binary")
    packed = rows.select("rid", pack("text").alias("text"))
    windows = cut(
        map_batches(packed.join(chosen, "rid").select("rid", "text", "spans"), _window_printer(window), "f1 BIGINT, f2 BIGINT, rid BIGINT, begin INT")
    )
    release(spark)
    twice = windows.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    single = windows.join(twice, ["f1", "f2"], "left_semi").select("rid", "begin", F.lit(window).alias("words"))
    return whole.unionByName(single).groupBy("rid").agg(F.collect_set(F.struct("begin", "words")).alias("runs"))


KEPT = "n_words BIGINT, n_removed BIGINT, kept STRING"


def _remover(n_keys: int):
    def remove(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            texts = pa.array(_unpacked(part.column(n_keys).to_pylist()), pa.binary()).cast(pa.string())
            first, _, begin, end, data = words_of(texts)
            runs = part.column(n_keys + 1)
            size = pa.compute.list_value_length(runs).fill_null(0).to_numpy(zero_copy_only=False)
            of, flat = np.repeat(np.arange(len(part)), size), runs.flatten()
            a = first[of] + flat.field("begin").to_numpy()
            change = np.zeros(len(begin) + 1, np.int64)
            np.add.at(change, a, 1)
            np.add.at(change, a + flat.field("words").to_numpy(), -1)
            covered = np.cumsum(change[:-1]) > 0
            whole, kept = data.tobytes(), []
            for d in range(len(part)):
                here = np.arange(first[d], first[d + 1])[~covered[first[d] : first[d + 1]]]
                kept.append(b" ".join([whole[x:y] for x, y in zip(begin[here].tolist(), end[here].tolist())]))
            removed = np.concatenate([[0], np.cumsum(covered)])[first]
            keys = [part.column(c) for c in range(n_keys)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(np.diff(first)), pa.array(np.diff(removed)), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*batch.schema.names[:n_keys], "n_words", "n_removed", "kept"],
            )

    return remove


def remove_repeats(docs: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """(keys, n_words, n_removed, kept) per row of ``docs (keys, text)``; ``kept`` is what is left, words joined
    by one blank. A key named like one of the results comes back as ``key_<name>``."""
    from pyspark.sql.functions import arrow_udf

    # Rows that agree in keys and text share a number, a hash of both; they are copies of each other all the same.
    # The caller's names come back at the end.
    named = [f"_key{i}" for i in range(len(keys))]
    docs = docs.select(F.xxhash64(*keys, "text").alias("rid"), *[F.col(k).alias(n) for k, n in zip(keys, named)], "text")
    taken = [c.split()[0] for c in KEPT.split(", ")]
    renamed = [f"key_{k}" if k in taken else k for k in keys]
    keys = named
    runs = repeated_runs(docs.select("rid", "text"), window)
    pack = arrow_udf(_packed, "binary")
    packed = docs.select("rid", *keys, pack("text").alias("text"))
    joined = packed.join(runs, "rid", "left").select(*keys, "text", "runs")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keys]
    return map_batches(joined, _remover(len(keys)), ", ".join([*kinds, KEPT])).toDF(*renamed, *taken)
