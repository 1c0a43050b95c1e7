"""Quality of documents by gradient-boosted trees over document statistics (operator 2).

Statistics are taken from the bytes and words of a text, for many texts at once with numpy: shares of
kinds of characters, word lengths, and how much is repeated. Trees are grown on histograms: each statistic
is cut into at most ``BINS`` bins at quantiles of the training sample, and a split is chosen from sums of
gradients per bin. A fitted model is three arrays over all trees (feature, threshold, leaf value) in heap
order, and a batch of documents walks down all trees at once.

The fit takes at most ``PER_CLASS`` labelled documents of each label, never held-out ones; statistics
of the sample are gathered by Spark and only they (a row of numbers per document) go to the driver.
Scoring is a column function over every whole text, so nothing is shuffled and other columns stay as they are.

An empty or null text has all statistics zero and gets a score like any other. Without labels of both
kinds the score is the share of label 1 (0.5 without any label). Repeated rows get equal scores.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tomewise.llm.common import slices, text_bytes, words_of
from tomewise.llm.labelled import sample

PER_CLASS = {0: 8000, 1: 12000}
BINS = 64
TREES, DEPTH, RATE = 60, 4, 0.2
MIN_WEIGHT, PENALTY = 4.0, 1.0
ACCEPT = 0.7

# Kinds of bytes whose shares are counted.
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9, 11, 12, 13),
    "line": (10,), "stop": b".,;:", "bang": b"!?", "mark": b"#$%&*@^~", "bar": b"|_=+<>/\\", "quote": b"\"'`()[]{}-",
}
_KIND = np.full(256, len(_KINDS) + 1, np.int64)
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes)] = _i
_KIND[128:] = len(_KINDS)
_N_KINDS = len(_KINDS) + 2


def _by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``, empty ones included."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(doc: np.ndarray, key: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys per document, and the count of the most frequent one."""
    order = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
    begin = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.empty(0, int)
    runs = np.diff(np.append(begin, len(order)))
    of = (order[begin] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n_docs)
    np.maximum.at(most, of, runs)
    return np.bincount(of, minlength=n_docs).astype(float), most


def _slice_statistics(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    first, (word,), begin, end, data = words_of(texts, lower=True)
    _, offsets = text_bytes(texts)
    size, words = np.diff(offsets).astype(float), np.diff(first).astype(float)
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc_of_byte * _N_KINDS + _KIND[data], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
    doc_of_word = np.repeat(np.arange(n), np.diff(first))
    length = (end - begin).astype(float)
    some, chars = np.maximum(words, 1), np.maximum(size, 1)
    mean = _by_doc(length, first) / some
    spread = np.sqrt(np.maximum(_by_doc(length**2, first) / some - mean**2, 0))
    distinct, most = _repeats(doc_of_word, word, n)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
    last = data[end - 1] if len(end) else np.empty(0, np.uint8)
    ends_stop, ends_mark = (np.isin(last, list(b)).astype(float) for b in (b".,;:", b"!?#$%&*|"))
    starts_upper = ((data[begin] >= 65) & (data[begin] <= 90)).astype(float) if len(begin) else length
    # Lines by the hash of their words: a line is the words between two line breaks.
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[begin] if len(begin) else np.empty(0, np.int64)
    new = np.ones(len(word), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc_of_word[1:] != doc_of_word[:-1])
    head = np.flatnonzero(new)
    place = np.arange(len(word)) - np.repeat(head, np.diff(np.append(head, len(word))))
    key = np.add.reduceat(word * (2 * place + 1).astype(np.uint64), head) if len(head) else word
    lines = np.bincount(doc_of_word[head], minlength=n).astype(float)
    distinct_lines, _ = _repeats(doc_of_word[head], key, n)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), mean, spread, distinct / some, most / some,
            _by_doc(same, first) / some, _by_doc(ends_stop, first) / some, _by_doc(ends_mark, first) / some,
            _by_doc(starts_upper, first) / some, words / np.maximum(lines, 1), distinct_lines / np.maximum(lines, 1),
            kinds / chars[:, None],
        ]
    ).astype(np.float32)


N_STATISTICS = 12 + _N_KINDS


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``N_STATISTICS`` numbers per text."""
    parts = [_slice_statistics(part) for _, part in slices(texts)]
    return np.concatenate(parts) if parts else np.empty((0, N_STATISTICS), np.float32)


@dataclass(frozen=True)
class Trees:
    """All trees as arrays: node i of a tree has the children 2i+1 and 2i+2; the last level are leaves."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; go right above it
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        n_inner = self.feature.shape[1]
        tree = np.arange(len(self.feature))
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            rows = x[at : at + 4096]
            node = np.zeros((len(rows), len(tree)), np.int64)
            of = np.arange(len(rows))[:, None]
            for _ in range(int(np.log2(n_inner + 1))):
                right = rows[of, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            total = self.base + self.leaf[tree, node - n_inner].sum(axis=1)
            out[at : at + len(rows)] = 1 / (1 + np.exp(-total))
        return out


def grow(x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH, rate=RATE, bins=BINS) -> Trees:
    """Boost logistic loss. Ties between splits go to the first feature and bin."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        none = np.empty((0, 1))
        return Trees(base, none.astype(int), none, none)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    n_inner = (1 << depth) - 1
    feature = np.zeros((trees, n_inner), np.int64)
    threshold = np.full((trees, n_inner), np.inf, np.float32)
    leaf = np.zeros((trees, n_inner + 1))
    place = np.arange(m) * bins + binned
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (m * bins) + place).ravel()
            g, h = (
                np.bincount(cell, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2)
                for v in (grad, weight)
            )
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
            gain[(h < MIN_WEIGHT) | (all_h - h < MIN_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, cell_ in enumerate(best):
                j, b = divmod(int(cell_), bins)
                if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + i], threshold[t, first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        g, h = (np.bincount(node - n_inner, v, n_inner + 1) for v in (grad, weight))
        leaf[t] = -rate * g / (h + PENALTY)
        total += leaf[t, node - n_inner]
    return Trees(base, feature, threshold, leaf)


@arrow_udf(T.ArrayType(T.FloatType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    rows = statistics(texts)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_STATISTICS), pa.array(rows.ravel())
    )


def fit(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], per_class=None) -> Trees:
    """A model from ``labels (doc_id, quality)``; ``fold`` (parts, part) is held out."""
    known = sample(docs, labels, "quality", fold, per_class or PER_CLASS)
    rows = known.select("doc_id", "label", statistics_of("text").alias("x")).toArrow().sort_by("doc_id")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, N_STATISTICS) if len(rows) else np.empty((0, N_STATISTICS))
    return grow(x, rows["label"].to_numpy().astype(float))


def score(model: Trees, text: str | Column) -> Column:
    """The probability of label 1 of a text column."""

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(texts)), pa.float64())

    return scored(text)
