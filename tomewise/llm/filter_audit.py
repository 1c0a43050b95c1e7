"""How five filters act on each other, over all orders in which they could run (operator 13).

Filters fail a text, whose words are what stands between the bytes 0x20 and 0x09 to 0x0D, for:

    A  fewer than ``LEAST_WORDS`` words
    B  fewer different words than ``DISTINCT_PERCENT`` percent of all
    C  more than ``CAPITAL_PERCENT`` percent of its code points are letters A to Z
    D  one of the marks ``MARKS``
    E  being identical to the text of a smaller doc_id anywhere in the table

A to D are read off each text. For E, texts go into radix tries: compressed tries over bytes whose terminals hold the
least doc_id of their text. A task first puts the texts it reads into tries of its own (``CHUNK`` bytes of text each),
which leave each different text once, so that a text of which there are many copies reaches the shuffle once per trie.
What is left is dealt out by ranges of a prefix of the text, as long as it has to be: of 4 bytes where those that
share them weigh less than a task should read, else of 16, 64, 256 or 1024; texts that are alike even there are told
apart by their digest as well, and copies of one heavy text are merged in several tasks first. Equal texts have
equal prefixes, so each range has its own trie, and a traversal says which doc_id is the least of its text.

What is left of a document is its part, five bits, and its labels. Counts of these are reduced for the parts, and all
120 orders are worked out from at most 32 counts a part.

A null text is empty, a null source is the empty part. A document without an id is no copy of anything and nothing is
a copy of it; it counts nonetheless. Rows that repeat an id and a text are not copies of each other, as neither id is
smaller; they count each. A document whose id has several labels is good or toxic if one of them says so. An
empty table has no parts and gives no rows. Other columns are not read.
"""

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import cut, slices, tasks

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]

CHUNK = 32 << 20
# Bytes of text that a range should have at least, and what a row weighs besides.
RANGE_BYTES, ROW_WEIGHT = 1 << 20, 64
LEVELS = (4, 16, 64, 256, 1024)
SALTS = 32
_BATCH = 4 << 20
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """The bits of filters A to D that a UTF-8 text fails."""
    words = text.split()  # bytes split at the six ASCII blanks only
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


class Node:
    __slots__ = ("edges", "least", "mask", "rows")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.least: int | None = None
        self.mask = 0
        self.rows: dict[str, int] = {}


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``text[at:]``, which is shorter than ``label``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A radix trie over bytes; a terminal has the least id of its text, its mask, and its rows by source."""

    def __init__(self):
        self.root = Node()
        self.size = 0

    def node(self, text: bytes) -> Node:
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Node()
                node.edges[text[at]] = text[at:], leaf
                self.size += len(text) - at + ROW_WEIGHT
                return leaf
            label, below = edge
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            same = _shared(label, text, at)
            middle = Node()
            middle.edges[label[same]] = label[same:], below
            node.edges[text[at]] = label[:same], middle
            node, at = middle, at + same
        return node

    def put(self, text: bytes, doc_id: int, source: str, mask: int, n: int) -> list[tuple[int, str, int, int]]:
        """Insert rows of one document; rows (doc_id, source, mask, n) that are known to be copies from now on."""
        node = self.node(text)
        if node.least is None or doc_id < node.least:
            copies = [] if node.least is None else [(node.least, s, node.mask | COPY, k) for s, k in node.rows.items()]
            node.least, node.mask, node.rows = doc_id, mask, {source: n}
            return copies
        if doc_id == node.least:
            node.rows[source] = node.rows.get(source, 0) + n
            return []
        return [(doc_id, source, mask | COPY, n)]

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        ahead = [(b"", self.root)]
        while ahead:
            text, node = ahead.pop()
            if node.least is not None:
                yield text, node
            ahead += [(text + label, below) for label, below in node.edges.values()]


# ``text`` is null once it is known whether the row is a copy.
ROWS = pa.schema(
    [("doc_id", pa.int64()), ("source", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())]
)
SCHEMA = "doc_id BIGINT, source STRING, mask INT, n BIGINT, text BINARY"


class _Rows:
    """Rows on their way out, in batches of bounded bytes."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += ROW_WEIGHT + len(row[4] or b"")
        if self.size >= _BATCH:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), ROWS)] if self.rows else [pa.array([], f.type) for f in ROWS]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=ROWS)


def _left(trie: Trie, out: _Rows, settled: bool) -> Iterator[pa.RecordBatch]:
    """The rows that a trie holds: with their text, or as no copies where it has seen all there is."""
    for text, node in trie.terminals():
        for source, n in node.rows.items():
            yield from out.add(node.least, source, node.mask, n, None if settled else text)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, source, text) as rows, each different text of a chunk once."""
    trie, out = Trie(), _Rows()
    for batch in batches:
        for at, texts in slices(batch.column(2)):
            ids, sources = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (0, 1))
            for doc_id, source, text in zip(ids, sources, texts.cast(pa.binary()).to_pylist()):
                mask = failures(text)
                if doc_id is None:
                    yield from out.add(None, source, mask, 1, None)
                    continue
                for copy in trie.put(text, doc_id, source, mask, 1):
                    yield from out.add(*copy, None)
            if trie.size >= CHUNK:
                yield from _left(trie, out, settled=False)
                trie = Trie()
    yield from _left(trie, out, settled=False)
    yield out.flush()


def _merger(settled: bool):
    """Rows of one range as one trie."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), _Rows()
        for batch in batches:
            for at in range(0, len(batch), 256):
                for doc_id, source, mask, n, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    for copy in trie.put(text, doc_id, source, mask, n):
                        yield from out.add(*copy, None)
        yield from _left(trie, out, settled)
        yield out.flush()

    return merge


def _with_prefix(rows: DataFrame, parts: int) -> tuple[DataFrame, bool]:
    """``rows`` with a ``prefix`` that is as long as it has to be, and whether ``heavy`` rows, alike up to the
    longest prefix, are among them."""
    weight = F.octet_length("text").cast("long") + ROW_WEIGHT
    total = rows.agg(F.sum(weight)).first()[0] or 0
    target = max(RANGE_BYTES, total // parts)
    names = list(rows.columns)
    light, undecided, heavy = F.lit(None).cast("binary"), rows, False
    for level in LEVELS:
        head = F.substring("text", 1, level)
        # At most total / target rows, a number of ranges.
        weighty = cut(undecided.groupBy(head.alias(f"h{level}")).agg(F.sum(weight).alias("w")).filter(F.col("w") > target).drop("w"))
        rows = rows.join(F.broadcast(weighty), head == F.col(f"h{level}"), "left")
        light = F.coalesce(light, F.when(F.col(f"h{level}").isNull(), head))
        undecided = undecided.join(F.broadcast(weighty), head == F.col(f"h{level}"), "left_semi")
        heavy = not weighty.isEmpty()
        if not heavy:
            break
    longest = F.concat(F.substring("text", 1, LEVELS[-1]), F.unhex(F.md5("text")))
    return rows.select(*names, F.coalesce(light, longest).alias("prefix"), light.isNull().alias("heavy")), heavy


def failed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mask, n): documents of ``docs (doc_id, source, text)`` by the bits of the filters they fail."""
    spark = docs.sparkSession
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("text").cast("string").alias("text"),
    )
    names = ROWS.names
    # Written down, as the prefixes are counted and the ranges sampled before the rows move.
    rows = cut(docs.mapInArrow(_local, SCHEMA))
    parts = tasks(spark)
    known, open_ = rows.filter("text IS NULL"), rows.filter("text IS NOT NULL")
    placed, heavy = _with_prefix(open_, parts)
    if heavy:
        # Copies of one heavy text come from every chunk: in several tasks first, so that few are left for one.
        salted = placed.filter("heavy").repartition(parts, "prefix", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        merged = cut(salted.select(*names).mapInArrow(_merger(settled=False), SCHEMA))
        known = known.unionByName(merged.filter("text IS NULL"))
        again = merged.filter("text IS NOT NULL")
        longest = F.concat(F.substring("text", 1, LEVELS[-1]), F.unhex(F.md5("text")))
        placed = placed.filter("NOT heavy").select(*names, "prefix").unionByName(again.withColumn("prefix", longest))
    ranged = placed.repartitionByRange(parts, "prefix").select(*names)
    settled = ranged.mapInArrow(_merger(settled=True), SCHEMA)
    return known.unionByName(settled).drop("text")


def _labelled(labels: DataFrame) -> DataFrame:
    """(id, good, toxic) of the ids that are one or the other."""
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    of = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    return of.agg(one("quality").alias("good"), one("toxic").alias("toxic")).filter("good + toxic > 0")


def _sum(fits, field: str) -> Column:
    """Sum of a field over the counts of a part whose mask fits."""
    chosen = F.filter("cells", lambda c: fits(c["mask"]))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda total, c: total + c[field])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step (1 to 5) with the counts of documents

    kept (after this step), removed (here), redundant (failing its filter, removed earlier), unique_fails (failing its
    filter only), good_lost and toxic_lost (removed here, with that label), and shapley (removed by its filter, summed
    over all orders). ``labels`` is (doc_id, quality, toxic).
    """
    rows = failed(docs)
    known = _labelled(labels)
    marked = rows.join(known, rows.doc_id == known.id, "left")
    cells = marked.groupBy(F.col("source").alias("part"), "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    # At most 32 counts a part.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = parts.select("*", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    bits = lambda letters: sum(
        (F.when(F.instr(letters, x) > 0, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0)
    )
    steps = steps.select(
        "*",
        bits(F.substring("filter_order", F.col("step"), F.lit(1))).alias("own"),
        bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)).alias("earlier"),
    )
    own, earlier = F.col("own"), F.col("earlier")
    fails = lambda mask: mask.bitwiseAND(own) != 0
    here = lambda mask: fails(mask) & (mask.bitwiseAND(earlier) == 0)
    counted = steps.select(
        "part",
        "filter_order",
        "step",
        _sum(lambda m: m.bitwiseAND(own.bitwiseOR(earlier)) == 0, "n").alias("kept"),
        _sum(here, "n").alias("removed"),
        _sum(lambda m: fails(m) & (m.bitwiseAND(earlier) != 0), "n").alias("redundant"),
        _sum(lambda m: m == own, "n").alias("unique_fails"),
        _sum(here, "good").alias("good_lost"),
        _sum(here, "toxic").alias("toxic_lost"),
        F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
    )
    # At most 600 rows a part.
    shapley = counted.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shapley, ["part", "filter"]).select(
        *[c for c in counted.columns if c != "filter"], "shapley", "filter"
    )
