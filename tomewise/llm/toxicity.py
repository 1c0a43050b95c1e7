"""Toxicity by compression distance (operator 7).

Two zstandard dictionaries are made, one of windows that mark toxic text and one trained on windows of
ordinary text. Every window of a text is compressed with both; the window speaks for toxic text by the
number of bytes that the toxic dictionary saves over the ordinary one. A text counts by its ``TOP`` windows
that speak most, weighed by a logistic regression that is calibrated on the training sample.

A window is ``window_words`` words in a row, in lower case. It is compressed behind a fixed carrier that
both dictionaries hold, since zstandard stores very short inputs as they are. Windows mark toxic text if
they stand in ``SUPPORT`` of the toxic sample and are ``RATIO`` times as frequent there; Spark counts them over
the sample, and only bounded lists of the most frequent reach the driver.

Copies of a text count once in the fit. A text without words has no window and gets the score of texts that nothing
speaks for. Without marking windows (as with an empty table) the score is the share of toxic labels, but below 0.5.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tomewise.llm.common import WORD
from tomewise.llm.labelled import sample

PER_CLASS = {0: 10000, 1: 4000}
TOXIC_WINDOWS, ORDINARY_WINDOWS = 2000, 20000
SUPPORT, RATIO = 0.02, 8
DICTIONARY_BYTES, SEGMENT, STEP, LEVEL = 112640, 12, 6, 19
TIMES = 20
TOP = 3
NOTHING = -8
# Windows whose lengths a worker remembers; beyond that it starts over. It only saves time.
REMEMBERED = 400_000
CARRIER = "\x01\x02 carrier of the window \x03\x04"
_WORD = re.compile(WORD)


def windows(text: str, words: int) -> list[str]:
    found = _WORD.findall(text.lower())
    if words == 1:
        return found
    return [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []


def _framed(window: str) -> bytes:
    return f"{CARRIER} {window} ".encode()


def train(counted: list[tuple[str, int]], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most ``size`` bytes from windows and how many texts they stand in."""
    samples = [_framed(w) for w, n in counted for _ in range(min(TIMES, n))]
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=STEP).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer
        return content(counted)


def content(counted: list[tuple[str, int]], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the windows themselves, the most frequent at its end, where matches are cheapest.

    The trainer leaves out segments that occur in few samples, and of the marking windows none may go.
    """
    return b"".join(_framed(w) for w, _ in reversed(counted))[-size:]


@dataclass
class Distance:
    """How much better the toxic dictionary compresses a window, in bytes."""

    toxic: bytes
    ordinary: bytes
    words: int

    def __post_init__(self):
        self.known: dict[str, int] = {}
        self.pair = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.words

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.words = state
        self.__post_init__()

    def _compressors(self):
        if self.pair is None:
            self.pair = [
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d),
                    write_checksum=False, write_content_size=False, write_dict_id=False,
                ).compress
                for d in (self.ordinary, self.toxic)
            ]
        return self.pair

    def top(self, text: str) -> list[int]:
        """The ``TOP`` windows that speak most for toxic text; ``NOTHING`` where there are fewer."""
        said = set(windows(text, self.words))
        known = self.known
        missing = said.difference(known)
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = said
        ordinary, toxic = self._compressors()
        for w in missing:
            framed = _framed(w)
            known[w] = len(ordinary(framed)) - len(toxic(framed))
        best = sorted(map(known.__getitem__, said), reverse=True)[:TOP]
        return best + [NOTHING] * (TOP - len(best))


@dataclass(frozen=True)
class Model:
    distance: Distance | None
    weights: np.ndarray  # one for each of the top windows, then the constant

    def score(self, texts: list[str]) -> np.ndarray:
        if self.distance is None:
            x = np.zeros((len(texts), TOP))
        else:
            x = np.array([self.distance.top(t) for t in texts], float).reshape(-1, TOP)
        return 1 / (1 + np.exp(-(x @ self.weights[:-1] + self.weights[-1])))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, with a small penalty that keeps it finite."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = 0.1 * np.eye(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += step
    return w


def _counted(known: DataFrame, words: int) -> DataFrame:
    """(window, toxic, ordinary): texts of each label that hold it."""

    @arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(set(windows(t, words))) for t in texts.fill_null("").to_pylist()], pa.list_(pa.string()))

    exploded = known.select("label", F.explode(of("text")).alias("window"))
    return exploded.groupBy("window").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary")
    )


def fit(docs: DataFrame, labels: DataFrame, fold: tuple[int, int], window_words: int = 1, per_class=None) -> Model:
    """A model from ``labels (doc_id, toxic)``; ``fold`` (parts, part) is held out."""
    drawn = sample(docs, labels, "toxic", fold, per_class or PER_CLASS)
    # The first of equal texts: at most as many ids as the sample has rows.
    firsts = drawn.groupBy(F.xxhash64("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    known = drawn.join(F.broadcast(firsts), "doc_id", "left_semi")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    toxic, ordinary = n.get(1, 0), n.get(0, 0)
    prior = min((toxic + 0.5) / (toxic + ordinary + 1), 0.49)
    nothing = Model(None, np.array([0.0] * TOP + [np.log(prior / (1 - prior))]))
    if not toxic or not ordinary:
        return nothing
    counted = _counted(known, window_words)
    marks = (
        counted.filter(F.col("toxic") >= max(3, SUPPORT * toxic))
        .filter(F.col("toxic") / toxic >= RATIO * (F.col("ordinary") + 1) / ordinary)
        .orderBy(F.desc("toxic"), "window")
        .limit(TOXIC_WINDOWS)
    )
    common = counted.orderBy(F.desc("ordinary"), "window").limit(ORDINARY_WINDOWS)
    marks = [(r.window, r.toxic) for r in marks.collect()]
    common = [(r.window, r.ordinary) for r in common.collect() if r.ordinary]
    if not marks or not common:
        return nothing
    distance = Distance(content(marks), train(common), window_words)

    @arrow_udf("array<int>")
    def tops(texts: pa.Array) -> pa.Array:
        return pa.array([distance.top(t) for t in texts.fill_null("").to_pylist()], pa.list_(pa.int32()))

    rows = known.select("doc_id", "label", tops("text").alias("x")).toArrow().sort_by("doc_id")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, TOP).astype(float)
    return Model(distance, calibrate(x, rows["label"].to_numpy().astype(float)))


def score(model: Model, text: str | Column) -> Column:
    """The probability of a toxic label of a text column."""

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [model.score(texts.slice(i, 64).fill_null("").to_pylist()) for i in range(0, len(texts), 64)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return scored(text)
