"""The filter audit against a loop over all orders, and its tries against sets."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tomewise.llm import filter_audit
from tomewise.llm.filter_audit import Trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id BIGINT, source STRING, text STRING"
LABELS = "doc_id BIGINT, quality INT, toxic INT"


def some_docs(seed, n=120):
    rng, out = random.Random(seed), []
    plain = " ".join(f"w{i}" for i in range(60))
    for i in range(n):
        kind = rng.randrange(7)
        text = [
            plain, plain + f" {i % 9}", "word " * 60, "SHOUT " * rng.randrange(3) + plain, "a # b " * rng.randrange(4),
            plain.upper(), plain[: rng.randrange(len(plain))],
        ][kind]
        out.append((rng.randrange(3 * n), rng.choice(["s1", "s2", None, ""]), text))
    odd = [
        (None, "s1", plain), (None, None, None), (5, "s1", None), (6, "s2", ""), (5, "s3", ""), (7, "s3", " \n\x0b"),
        (8, "s1", "É\x1cword " * 70), (8, "s1", "É\x1cword " * 70), (8, "s2", "É\x1cword " * 70),
        (9, "s4", "x" * 9000), (10, "s4", "x" * 9000 + "y"), (-3, "s4", "x" * 9000), (11, "s4", "日本 " * 400),
    ]
    return [*out, *odd]


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    ids = {}
    for i, _, t in docs:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    failing = []
    for i, s, t in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and min(ids[t]) < i,
        }
        failing.append((s or "", i, {f for f in fails if fails[f]}))
    out = []
    for part in {s for s, _, _ in failing}:
        mine = [(i, f) for s, i, f in failing if s == part]
        total = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = mine
            for step, own in enumerate(order, 1):
                gone = [(i, f) for i, f in left if own in f]
                left = [(i, f) for i, f in left if own not in f]
                total[own] += len(gone)
                lines.append((
                    own, part, "".join(order), step, len(left), len(gone),
                    sum(own in f for _, f in mine) - len(gone), sum(f == {own} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ))
        out += [(*line[1:], total[line[0]], line[0]) for line in lines]
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("small", [False, True])
def test_counts_are_those_of_running_every_order(spark, monkeypatch, small):
    if small:  # every prefix is weighty, down to texts that are merged in several tasks first
        for name, value in (("CHUNK", 300), ("RANGE_BYTES", 1), ("LEVELS", (2, 8)), ("SALTS", 3)):
            monkeypatch.setattr(filter_audit, name, value)
    docs = some_docs(3)
    labels = [(i, i % 2, i % 3 == 0) for i, _, _ in docs[::2] if i is not None]
    labels = [(i, int(q), int(t)) for i, q, t in labels] + [(5, 0, None), (5, 1, 1), (None, 1, 1), (4711, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumn("part", F.lit(1)).withColumn("mask", F.lit("x"))
    got = rows(filter_audit.audit(df.repartition(5), spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels)


def test_no_documents_no_parts(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(nothing, spark.createDataFrame([], LABELS)).collect() == []


def test_tries_tell_texts_apart():
    rng, trie, least = random.Random(1), Trie(), {}
    for i in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))
        doc_id = rng.randrange(10_000)
        trie.put(text, doc_id, "s", 0, 1)
        least[text] = min(least.get(text, doc_id), doc_id)
    assert {text: node.least for text, node in trie.terminals()} == least
