"""Groups of documents whose sets of word shingles are alike (operator 10).

Two documents link when 100 * |intersection| >= ``percent`` * |union|. The join gives each document its set size and
the component it belongs to through links, and loses no link between different texts:

1. Equal sets are one node from here on: sets are compared by two 64-bit sums of their members' hashes.
2. Two linked sets share a member among the first |set| - ceil(percent * |set|) + 1 of each, in any one order of all
   shingles (here by hash, with shingles that are frequent in a sample put last, so that common passages
   do not bring documents together). Only these prefixes are shuffled. Prefix members that two nodes have
   make tiles; a pair in a tile stays if its sizes and the bit counts of its bitmaps allow the overlap. Tiles of
   more than ``TILE`` nodes are cut into pairs of blocks. Pairs already connected are not looked at again, so many
   near copies of one text cost about a comparison each.
3. Connected candidates meet once more with their texts, in tiles of one band of sizes and the next; in these the
   bitmaps bound the overlap from above, and what passes is decided by intersecting the sorted sets.

A bitmap has a bit for each member, hashed into as many bits as the set has members, rounded up to a power
of two; a wider one is folded for a narrower partner. If two bitmaps differ in d bits, the sets differ in at
least d members, so the similarity is at most (s - d) / (s + d) for s = |a| + |b|.

Shingles are 64-bit hashes. A document with fewer words than a shingle is one shingle, its whole
sequence. Without words (null or empty text) it has none and links with nothing. A null doc_id has no component. Rows
that repeat a doc_id are one document in the links: each different text is a node of its own, and all their texts are in
one component.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import cut, cut_at, drop_table, map_batches, mix, read_texts, release, slices, split_by_ids, tasks, words_of
from tomewise.llm.components import components

WORDS, PERCENT = 4, 85
TILE = 256
CLUSTER_TILE = 512
# The sample that frequent shingles are taken from; it decides the order of shingles, never the result.
SAMPLE_DOCS, SAMPLE_TIMES, FREQUENT = 4000, 4, 20_000
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER = np.uint64(0x165667B19E3779F9)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text's set, and the sets: sorted distinct 64-bit numbers."""
    first, (word,), *_ = words_of(texts, lower=True)
    count = np.diff(first)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    value = np.full(len(doc), words, np.uint64)
    for i in range(words):
        inside = i < count[doc]
        value = np.where(inside, value * _BASE + word[np.minimum(at + i, max(len(word) - 1, 0))], value) if len(word) else value
    value = mix(value ^ np.minimum(count, words)[doc].astype(np.uint64))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return np.searchsorted(doc, np.arange(len(n) + 1)), value


def width(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set: a power of two, 64 at least."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64)


def bitmap(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(int(width(np.array(len(values)))), np.uint8)
    bits[(mix(values) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def needed(n: int | np.ndarray, percent: int):
    """Least overlap of a set of n members with any linked set."""
    return -(-percent * n // 100)


def identity_of(bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of hashes of each set's members; with its size they tell sets apart."""
    total = lambda v: np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
    sums = total(mix(values)), total(mix(values ^ _OTHER))
    return tuple((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)


def _set_rows(percent: int, words: int, frequent: np.ndarray):
    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, texts in slices(batch.column(1)):
            bounds, values = shingle_sets(texts, words)
            n = np.diff(bounds)
            first, second = identity_of(bounds, values)
            late = frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] == values if len(frequent) else np.zeros(len(values), bool)
            prefix, maps = [], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                mine, last = values[a:b], late[a:b]
                size = b - a - needed(b - a, percent) + 1 if b > a else 0
                prefix.append(np.concatenate([mine[~last], mine[last]])[:size])
                maps.append(bitmap(mine).tobytes() if b > a else b"")
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = np.concatenate(prefix).view(np.int64) if prefix else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(texts)),
                    pa.array(n, pa.int64()),
                    pa.array(first),
                    pa.array(second),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array(maps, pa.binary()),
                ],
                names=["doc_id", "n", "h1", "h2", "prefix", "bits"],
            )

    return rows


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that stand in several documents of a bounded sample, at most ``FREQUENT`` of them."""

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batch.column(1)):
            _, values = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["s"])

    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    drawn = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")
    seen = map_batches(drawn, of, "s BIGINT").groupBy("s").count().filter(F.col("count") >= SAMPLE_TIMES)
    top = seen.orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").toArrow()["s"].to_numpy()
    return np.sort(top.view(np.uint64))


class Union:
    """Components of nodes 0..n-1 inside a task."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Connect pairs; which of them connected what was apart."""
        useful = []
        up = {}

        def root(x: int) -> int:
            path = []
            while x in up:
                path.append(x)
                x = up[x]
            for p in path:
                up[p] = x
            return x

        for i, (x, y) in enumerate(zip(self.label[a].tolist(), self.label[b].tolist())):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                useful.append(i)
        if up:
            final = np.arange(len(self.label))
            final[list(up)] = [root(x) for x in list(up)]
            self.label = final[self.label]
        return np.array(useful, np.int64)


class Bitmaps:
    """Bitmaps of several widths; pairs are compared at the width of the narrower."""

    def __init__(self, maps: list[bytes]):
        self.maps = maps
        self.bits = np.array([len(m) * 8 for m in maps], np.int64)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Row of each node in the matrix of width w, which has nodes of width w and 2w."""
        if w not in self.by_width:
            row = np.full(len(self.maps), -1)
            own, twice = np.flatnonzero(self.bits == w), np.flatnonzero(self.bits == 2 * w)
            row[own], row[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            flat = lambda ns, k: np.frombuffer(b"".join(self.maps[i] for i in ns), np.uint64).reshape(len(ns), k * w // 64)
            double = flat(twice, 2)
            # The bit of a member is its hash modulo the width: halves lie on each other.
            folded = double[:, : w // 64] | double[:, w // 64 :]
            self.by_width[w] = row, np.concatenate([flat(own, 1), folded])
        return self.by_width[w]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of each pair differ; 0 where widths are further apart than twofold."""
        out = np.zeros(len(a), np.int64)
        w = np.minimum(self.bits[a], self.bits[b])
        near = np.maximum(self.bits[a], self.bits[b]) <= 2 * w
        for each in np.unique(w[near]):
            here = np.flatnonzero(near & (w == each))
            row, matrix = self._at(int(each))
            for i in range(0, len(here), 1 << 15):
                some = here[i : i + (1 << 15)]
                out[some] = np.bitwise_count(matrix[row[a[some]]] ^ matrix[row[b[some]]]).sum(axis=1)
        return out


def possible(na: np.ndarray, nb: np.ndarray, d: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes, and bitmaps that differ in d bits, allow a link."""
    s = na + nb
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (100 * (s - d) >= percent * (s + d))


def _tile_edges(percent: int):
    """Candidate links of sorted tiles, only those that connect something new."""

    def edges_of(tile: np.ndarray, node: np.ndarray, n: np.ndarray, maps: list[bytes]) -> pa.RecordBatch:
        nodes, index, at = np.unique(node, return_index=True, return_inverse=True)
        bitmaps, union, found = Bitmaps([maps[i] for i in index]), Union(len(nodes)), []
        a = np.arange(len(tile))
        for step in range(1, len(tile)):
            a = a[a + step < len(tile)]
            a = a[tile[a] == tile[a + step]]
            if not len(a):
                break
            x, y = at[a], at[a + step]
            apart = union.label[x] != union.label[y]
            x, y = x[apart], y[apart]
            pair = np.unique(np.minimum(x, y) * len(nodes) + np.maximum(x, y))
            x, y = pair // len(nodes), pair % len(nodes)
            size = n[index]
            ok = possible(size[x], size[y], np.zeros(len(x), int), percent)
            x, y = x[ok], y[ok]
            ok = possible(size[x], size[y], bitmaps.differ(x, y), percent)
            x, y = x[ok], y[ok]
            new = union.link(x, y)
            found.append((nodes[x[new]], nodes[y[new]]))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            tile = table["tile"].to_numpy()
            # The last tile may go on in the next batch; tiles are bounded.
            end = int(np.searchsorted(tile, tile[-1], "left")) if len(tile) else 0
            if end:
                yield run(table.slice(0, end))
            left = table.slice(end).combine_chunks().to_batches()
            rest = left[0] if left else None
        if rest is not None and len(rest):
            yield run(pa.Table.from_batches([rest]))

    def run(t: pa.Table) -> pa.RecordBatch:
        return edges_of(t["tile"].to_numpy(), t["node"].to_numpy(), t["n"].to_numpy(), t["bits"].to_pylist())

    return stream


def _blocks(count: Column, key: Column, size: int) -> Column:
    """The pairs of blocks a row belongs to, as numbers; a single one for groups of up to ``size``."""
    n = F.ceil(count / size).cast("int")
    mine = F.pmod(F.xxhash64(key), n).cast("int")
    pair = lambda j: F.least(mine, j) * n + F.greatest(mine, j)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), pair))


def _cluster_edges(percent: int, words: int):
    def edges(table: pa.Table) -> pa.Table:
        texts = table["text"].combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        nodes, n, h1, h2 = (table[name].to_numpy() for name in ("node", "n", "h1", "h2"))
        node, sets = [], []
        for at, part in slices(texts):
            bounds, values = shingle_sets(part, words)
            first, second = identity_of(bounds, values)
            here = slice(at, at + len(part))
            # Other texts of a repeated doc_id are nodes of their own.
            mine = (np.diff(bounds) == n[here]) & (first == h1[here]) & (second == h2[here])
            for i in np.flatnonzero(mine).tolist():
                node.append(nodes[at + i])
                sets.append(values[bounds[i] : bounds[i + 1]])
        node, n = np.array(node, np.int64), np.array([len(s) for s in sets], np.int64)
        order = np.lexsort((node, n))
        node, n, sets = node[order], n[order], [sets[i] for i in order]
        bitmaps, union, found = Bitmaps([bitmap(s).tobytes() for s in sets]), Union(len(node)), []
        for i in range(len(node)):
            # Sizes ascend: partners come from a band above.
            end = int(np.searchsorted(n, 100 * n[i] // percent, "right"))
            b = np.arange(i + 1, end)
            b = b[union.label[b] != union.label[i]]
            a = np.full(len(b), i)
            b = b[possible(n[a], n[b], bitmaps.differ(a, b), percent)]
            for j in b.tolist():
                if union.label[i] == union.label[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    union.link(np.array([i]), np.array([j]))
                    found.append((node[i], node[j]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return edges


def band_of(n: Column, percent: int) -> Column:
    """A number for each size, in whole numbers so that it is the same everywhere: bands are at least as wide as what
    a set may link with, so a set meets its partners in its own band or the next."""
    edges, low = [], 1
    while low < 1 << 40:
        low = 100 * low // min(percent, 95) + 1
        edges.append(low)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= n))


def groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs (doc_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id BIGINT, n BIGINT, h1 BIGINT, h2 BIGINT, prefix ARRAY<BIGINT>, bits BINARY"
    read_texts(spark)
    sets, sets_at = cut_at(map_batches(docs, _set_rows(percent, words, _frequent(docs, words)), schema))
    identity = ["n", "h1", "h2"]
    some = sets.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # A number for each different set, which holds once it is written. Written down, as are the shared members, so that
    # joins on a hot set or shingle can be split.
    least = some.groupBy(*identity).agg(F.min("doc_id").alias("least"))
    named = cut(least.withColumn("node", F.monotonically_increasing_id()))
    members_of = cut(sets.select("doc_id", *identity).join(named, identity, "left").select("doc_id", "n", "node"))
    nodes, nodes_at = cut_at(
        some.join(named, identity).filter(F.col("doc_id") == F.col("least"))
        .dropDuplicates(["node"]).select("node", *identity, "prefix", "bits")
    )
    # From here on a set is there once, and what brought it there is not read again.
    del sets, some, least
    drop_table(spark, sets_at)
    release(spark)

    # Tiles of nodes that share a prefix member.
    members = nodes.select("node", F.explode("prefix").alias("s"))
    shared, shared_at = cut_at(members.groupBy("s").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1))
    tiled = members.join(shared, "s").select(
        "node", "s", F.explode(_blocks(F.col("times"), F.col("node"), TILE)).alias("block")
    )
    tiled = tiled.select("node", F.xxhash64("s", "block").alias("tile"))
    full = tiled.join(nodes.select("node", "n", "bits"), "node")
    candidates, candidates_at = cut_at(
        full.select("tile", "node", "n", "bits").repartition(tasks(spark), "tile").sortWithinPartitions("tile", "node")
        .mapInArrow(_tile_edges(percent), "a BIGINT, b BIGINT")
    )
    clusters = cut(components(candidates))
    del members, shared, tiled, full, candidates, nodes
    for path in (shared_at, candidates_at, nodes_at):
        drop_table(spark, path)
    release(spark)

    # Clusters with their texts, in tiles of neighbouring bands of sizes.
    placed = clusters.join(named, "node").withColumn("band", band_of(F.col("n"), percent))
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("times"))
    whole = F.col("times") <= CLUSTER_TILE
    # A large cluster is cut by bands: a node stands in the tile of its own band and of the next.
    bands = F.when(whole, F.array(F.lit(0))).otherwise(F.array(F.col("band"), F.col("band") + 1))
    placed = placed.join(sizes, "component").withColumn("tile_band", F.explode(bands))
    per_band = placed.groupBy("component", "tile_band").agg(F.count(F.lit(1)).alias("here"))
    placed = placed.join(per_band, ["component", "tile_band"]).withColumn(
        "block", F.explode(_blocks(F.col("here"), F.col("node"), CLUSTER_TILE))
    )
    keys = cut(placed.select("node", "least", *identity, F.xxhash64("component", "tile_band", "block").alias("tile")))
    # Only texts of candidates move.
    _, with_text = split_by_ids(docs.filter("text IS NOT NULL"), "doc_id", keys.select("least").distinct())
    texts = keys.join(with_text, keys.least == with_text.doc_id).select("tile", "node", *identity, "text")
    links = cut(texts.groupBy("tile").applyInArrow(_cluster_edges(percent, words), "a BIGINT, b BIGINT"))

    known = members_of.filter(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    repeated = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("rows"))
    # All texts of a repeated doc_id hang together by the first of them.
    repeated = repeated.filter(F.col("a") != F.col("b")).select("doc_id", "a")
    together = known.join(repeated, "doc_id").select("a", F.col("node").alias("b")).distinct()
    joined = components(links.unionByName(together))
    joined = joined.join(named.select("node", "least"), "node")
    # The component's name is its smallest doc_id; that of a repeated one may belong to any of its texts.
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    found = joined.select("node", "component").join(smallest, "component").select("node", "component_id")
    alone = named.select("node", "least").join(found, "node", "left").select(
        "node", F.coalesce("component_id", "least").alias("component_id")
    )
    # Documents without shingles, or without an id, stay by themselves.
    rows = members_of.join(alone, "node", "left")
    by_itself = (F.col("n") == 0) | F.col("doc_id").isNull()
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(by_itself, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
