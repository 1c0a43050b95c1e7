"""Benchmark decontamination by the q-gram lemma (operator 4).

A document is contaminated by a benchmark item if some region of it turns into the item's text by at most
``share`` of the item's length in edits (insert, delete, replace a character). Both are compared as letters in
lower case with runs of blanks as one blank.

Lemma: a region within k edits of an item of m characters shares at least m - q + 1 - kq of its q-grams,
and all of them lie on diagonals (place in the document minus place in the item) that span at most k on either
side. So shared q-grams are counted in bands of diagonals, each 2k + 1 wide at least and overlapping the next by
half; a band that reaches the bound is a region, and a banded alignment of the item with it decides. The bound
grows with m, so q is chosen per item as the largest of ``QS`` for which it stays at ``LEAST_SHARED`` or more; items
too short for any are searched as they are (no edits). An item leaves out those of its q-grams that most items
have, and its bound is less by as many: the lemma still holds, and common phrases no longer count for anyone.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters, each broadcast and held against all documents
in one pass; a longer item makes a block of its own. Documents are never shuffled.

Null or empty texts and items take no part. Repeated documents and items give a row each. Other columns are
not read, but for the columns named in ``keys``; one that is named like a column of the result comes back as ``key_<name>``.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_BASE = np.uint64(0x9E3779B97F4A7C15)
SHARE = 0.1
QS, LEAST_SHARED = (12, 8, 6, 4), 8
BLOCK_CHARS = 8_000_000
# Marks q-grams of the block in a table of bits before they are looked up.
TABLE_BITS = 22
# Characters that are looked at together, but for what a band reaches beyond them.
WINDOW = 1 << 12
# Different regions of one text that are aligned with an item one by one; of more, the closest is found first.
SINGLE = 64
FOUND = "item_id BIGINT, begin BIGINT, end BIGINT, edits INT"
_BLANKS = re.compile(r"\s+")


def normal(text: str) -> str:
    return _BLANKS.sub(" ", text.lower()).strip()


def budget(m: int, share: float) -> tuple[int, int]:
    """Edits allowed for an item of m characters, and the q to filter with."""
    k = int(m * share)
    for q in QS:
        if m - q + 1 - k * q >= LEAST_SHARED:
            return k, q
    return k, max(1, m // (k + 1))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def qgrams(code: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of q characters, put together from runs of powers of two."""
    n = len(code) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, run, size = _BASE, code, 1
    total, done = None, 0
    while done < q:
        if q & size:
            part = run[done : done + n]
            total = part if total is None else total * base + part
            done += size
        if done < q:
            run = run[:-size] * base + run[size:]
            base, size = np.uint64(int(base) ** 2 & (1 << 64) - 1), 2 * size
    return total * _BASE


@dataclass
class Index:
    """The q-grams of a block of items, for each q that occurs."""

    items: list[tuple[int, str, int, int]]  # item_id, normal text, edits, q

    def __post_init__(self):
        self.tables, self.bound = {}, np.zeros(len(self.items), np.int64)
        self.codes = [codes(t) for _, t, _, _ in self.items]
        self.m = np.array([len(c) for c in self.codes])
        self.k = np.array([k for _, _, k, _ in self.items])
        self.grams = np.zeros(len(self.items), np.int64)
        for q in {i[3] for i in self.items}:
            mine = [n for n, i in enumerate(self.items) if i[3] == q]
            grams = [qgrams(self.codes[n], q) for n in mine]
            value, item = np.concatenate(grams), np.repeat(mine, [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            _, of, common = np.unique(value, return_inverse=True, return_counts=True)
            least = np.minimum(LEAST_SHARED, self.m - q + 1 - self.k * q)
            spare = self.m - q + 1 - self.k * q - least
            order = np.lexsort((place, -common[of], item))
            rank = np.empty(len(value), np.int64)
            first = np.searchsorted(item[order], item)
            rank[order] = np.arange(len(value))
            keep = (rank - first >= spare[item]) | (common[of] == 1)
            left_out = np.bincount(item[~keep], minlength=len(self.items))
            self.bound[mine] = (spare + least - left_out)[mine]
            self.grams[mine] = (self.m - q + 1 - left_out)[mine]
            value, item, place = value[keep], item[keep], place[keep]
            order = np.argsort(value, kind="stable")
            bits = np.zeros(1 << TABLE_BITS, bool)
            bits[value >> np.uint64(64 - TABLE_BITS)] = True
            self.tables[q] = (bits, value[order], item[order], place[order])

    def __getstate__(self):
        return self.items

    def __setstate__(self, items):
        self.items = items
        self.__post_init__()

    def hits(self, code: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in it, place in the document) of every shared q-gram."""
        bits, value, item, place = self.tables[q]
        gram = qgrams(code, q)
        at = np.flatnonzero(bits[gram >> np.uint64(64 - TABLE_BITS)])
        low = np.searchsorted(value, gram[at], "left")
        n = np.searchsorted(value, gram[at], "right") - low
        of = np.repeat(np.arange(len(at)), n)
        index = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return item[index], place[index], at[of]

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, begin, end, edits) in the normal text: the best region of every item found."""
        found, code = [], codes(text)
        for q in self.tables:
            if len(code) >= q:
                found += self._regions(text, code, q)
        return found

    def _regions(self, text: str, code: np.ndarray, q: int) -> Iterator[tuple[int, int, int, int]]:
        """Long texts go by windows that overlap by what a band can reach; equal windows are looked at once."""
        mine = [n for n, i in enumerate(self.items) if i[3] == q]
        reach = int((self.m + 6 * self.k + 2)[mine].max()) + q
        step = max(WINDOW, reach)
        long, known, found = len(code) > step + reach, {}, []
        for at in range(0, len(code), step):
            piece = code[at : at + step + reach]
            name = hashlib.blake2b(piece.tobytes()).digest() if long else b""
            if name not in known:
                known[name] = self._bands(piece, q)
            if len(known[name][0]):
                i, begin, end, n = known[name]
                found.append((i, begin + at, end + at, n))
        if not found:
            return
        i, begin, end, n = (np.concatenate(c) for c in zip(*found))
        begin, end = np.maximum(begin, 0), np.minimum(end, len(code))
        # Every edit costs q of the item's q-grams at most.
        least = np.maximum(0, -(-(self.grams[i] - n) // q))
        order = np.lexsort((begin, least, i))
        for each in np.unique(i):
            rows = order[slice(*np.searchsorted(i[order], [each, each + 1]))]
            region = self._best(text, code, int(each), zip(begin[rows].tolist(), end[rows].tolist(), least[rows].tolist()))
            if region:
                yield self.items[each][0], *region

    def _bands(self, code: np.ndarray, q: int) -> tuple[np.ndarray, ...]:
        """(item, begin, end, shared q-grams) of the bands that reach their item's bound; they may reach beyond ``code``."""
        item, place, at = self.hits(code, q)
        none = np.empty(0, np.int64)
        found = [(none, none, none, none)]
        enough = np.flatnonzero(np.bincount(item, minlength=len(self.items)) >= np.maximum(self.bound, 1))
        order = np.argsort(item, kind="stable") if len(enough) > 4 else None
        for i in enough.tolist():
            rows = np.flatnonzero(item == i) if order is None else order[slice(*np.searchsorted(item, [i, i + 1], sorter=order))]
            here, m, k = place[rows], int(self.m[i]), int(self.k[i])
            w = 2 * k + 1
            # Bands of 2(2k + 1) diagonals, each beginning 2k + 1 after the last: any 2k + 1 lie in one.
            half = (at[rows] - here + m) // w
            for shift in (0, 1):
                band = (half + shift) >> 1
                # The same q-gram may repeat inside a band; distinct ones of the item count.
                low = int(band.min())
                there = np.zeros((int(band.max()) - low + 1, m), bool)
                there[band - low, here] = True
                n = there.sum(axis=1)
                b = np.flatnonzero(n >= self.bound[i])
                middle = (2 * (b + low) - shift + 1) * w - m
                found.append((np.full(len(b), i), middle - w - k, middle + w + m + k, n[b]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _best(self, text: str, code: np.ndarray, i: int, bands) -> tuple[int, int, int] | None:
        """The region of item ``i`` with the fewest edits, the first of them, from bands (begin, end, least edits) in order of
        their edits and begin."""
        m, k = int(self.m[i]), int(self.k[i])
        # No alignment is better than the item itself.
        same = text.find(self.items[i][1])
        if same >= 0:
            return same, same + m, 0
        best, known, many = None, {}, []
        for begin, end, least in bands:
            if best and (least, begin) > (best[2], best[0]):
                if least > best[2]:
                    break
                continue
            if begin >= end:
                continue
            piece = code[begin:end]
            name = piece.tobytes()
            if name not in known:
                if len(known) >= SINGLE:
                    many.append((begin, end))
                    continue
                known[name] = align(self.codes[i], piece, k if best is None else min(k, best[2]))
            if found := known[name]:
                region = (begin + found[0], begin + found[1], found[2])
                best = min(best or region, region, key=lambda r: (r[2], r[0], r[1]))
        if many and (last := closest(self.codes[i], code, many, k if best is None else best[2])) is not None:
            begin = max(0, last - m - k)
            found = align(self.codes[i], code[begin:last], k)
            region = (begin + found[0], begin + found[1], found[2])
            best = min(best or region, region, key=lambda r: (r[2], r[0], r[1]))
        return best


def align(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """Where ``item`` fits into ``region`` with the fewest edits, at most k: (begin, end, edits).

    The region is a band of diagonals around the item, and so is what is aligned: each row of the
    table is the region's width less the item's length. Ties go to the first end.
    """
    m, n = len(item), len(region)
    if n < m - k:
        return None
    # cost[d] and start[d]: item[:i] against region ending at i + d - k, for diagonals d.
    width = max(n - m, 0) + 2 * k + 1
    d = np.arange(width)
    far = m + n + 1
    # The region with room on both sides: the letter before the end i + d - k is padded[i + d].
    padded = np.full(m + width + 1, -1, np.int64)
    room = min(n, m + width - k)
    padded[k + 1 : k + 1 + room] = region[:room].astype(np.int64)
    outside = padded < 0
    ends = np.arange(-k, m + width - k)
    invalid = (ends < 0) | (ends > n)
    letters = item.astype(np.int64).tolist()
    cost, start = np.where(invalid[:width], far, 0), d - k
    drop, after = np.full(width, far), np.zeros(width, np.int64)
    for i in range(1, m + 1):
        swap = cost + (padded[i : i + width] != letters[i - 1])
        swap[outside[i : i + width]] = far
        drop[:-1], after[:-1] = cost[1:] + 1, start[1:]
        take = swap <= drop
        new, begin = np.where(take, swap, drop), np.where(take, start, after)
        # Letters of the region that the item lacks: walk right along the row, one edit a step.
        slope = new - d
        low = np.minimum.accumulate(slope)
        at = np.maximum.accumulate(np.where(slope == low, d, 0))
        cost = low + d
        cost[invalid[i : i + width]] = far
        start = begin[at]
        # Costs never fall from row to row.
        if not i & 7 and cost.min() > k:
            return None
    best = int(cost.argmin())
    if cost[best] > k:
        return None
    return int(start[best]), int(m + best - k), int(cost[best])


def closest(item: np.ndarray, text: np.ndarray, regions: list[tuple[int, int]], k: int) -> int | None:
    """The first place in the regions (begin, end) where the item ends with the fewest edits, if these are k at most. A row
    of the table is a whole number whose bits are the differences between its cells, so a letter costs a few operations."""
    m = len(item)
    all_, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for j, letter in enumerate(item.tolist()):
        where[letter] = where.get(letter, 0) | 1 << j
    fewest, best, done = k + 1, None, 0
    up, down, cost = all_, 0, m
    for begin, end in sorted(regions):
        if begin > done:  # a gap: nothing that began before it goes on
            up, down, cost = all_, 0, m
        for at in range(max(begin, done), end):
            same = where.get(int(text[at]), 0) | down
            diagonal = (((same & up) + up) ^ up) | same
            right, left = down | (all_ & ~(diagonal | up)), up & diagonal
            cost += 1 if right & top else -1 if left & top else 0
            right <<= 1
            up, down = (left << 1 | ~(diagonal | right)) & all_, right & diagonal & all_
            if cost < fewest:
                fewest, best = cost, at + 1
        done = max(done, end)
    return best


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded block at a time, in order of their ids."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    block, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = normal(row.text)
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        if text:
            block.append((row.item_id, text))
            size += len(text)
    if block:
        yield block


def _searcher(index, n_keys: int, schema: list[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = cloudpickle.loads(index.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column(n_keys).fill_null("").to_pylist()
                found = [(i, *f) for i, t in enumerate(texts) if t for f in find.search(normal(t))]
                if found:
                    rows, ids, begin, end, edits = zip(*found)
                    keys = [part.column(c).take(pa.array(rows, pa.int64())) for c in range(n_keys)]
                    values = [pa.array(v, pa.int64()) for v in (ids, begin, end)]
                    yield pa.RecordBatch.from_arrays([*keys, *values, pa.array(edits, pa.int32())], names=schema)

    return search


def sent(context, block: list[tuple[int, str]], share: float):
    """The index of a block for all executors, as bytes that hold its class by value."""
    return context.broadcast(cloudpickle.dumps(Index([(n, t, *budget(len(t), share)) for n, t in block])))


def contaminated(docs: DataFrame, items: DataFrame, keys: list[str], share: float = SHARE) -> DataFrame:
    """(keys, item_id, begin, end, edits): for every document and item, the best region of the
    document's normal text that is within the edit budget of the item."""
    context = docs.sparkSession.sparkContext
    taken = [c.split()[0] for c in FOUND.split(", ")]
    renamed = [f"key_{k}" if k in taken else k for k in keys]
    docs = docs.select(*[F.col(k).alias(r) for k, r in zip(keys, renamed)], F.col("text").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in renamed]
    schema = ", ".join([*kinds, FOUND])
    names = [*renamed, *taken]
    found = docs.sparkSession.createDataFrame([], schema)
    for i, block in enumerate(blocks(items)):
        index = sent(context, block, share)
        part = docs.mapInArrow(_searcher(index, len(keys), names), schema)
        found = part if i == 0 else found.unionByName(part)
    return found


def _flagger(index):
    unpacked = []

    @arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        if not unpacked:
            unpacked.append(cloudpickle.loads(index.value))
        find = unpacked[0]
        return pa.array([bool(t and find.search(normal(t))) for t in texts.to_pylist()], pa.bool_())

    return hit


def without_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents of ``docs`` that no item contaminates, with all their columns."""
    context = docs.sparkSession.sparkContext
    for block in blocks(items):
        index = sent(context, block, share)
        docs = docs.filter(~_flagger(index)("text"))
    return docs
