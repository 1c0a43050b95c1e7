"""The conversation trie against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tomewise.llm import conv_trie

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def rebuilt(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, ms in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(ms) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, ms in members.items():
        ends = sorted(c for c in ms if len(convs[c]) == len(node))
        out.append((
            min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def invented(seed, n=60):
    rng, out = random.Random(seed), []
    for c in range(n):
        same = rng.random() < 0.4
        for turn in range(rng.choice([1, 2, 5, 12])):
            text = f"t{turn}" if same and turn < 9 else f"t{rng.randrange(4)} é" * rng.randrange(3)
            out.append((c * rng.choice([1, 1, 7]), turn, rng.choice(["user", "assistant"][: 1 + (turn > 6)]), text))
    odd = [
        (None, 0, "user", "nobody's"), (500, None, None, None), (500, 3, "user", "b"), (500, 3, "user", "a"), (500, 3, "assistant", "z"),
        (501, 0, "user", "again"), (501, 0, "user", "again"), (-7, 0, "user", "below zero"), (-5, 0, "user", "x"), (502, 0, "", ""),
        (1003, 0, "user", "x" * 40_000), (1004, 0, "user", "x" * 40_000 + "y"),
    ]
    long = [(700 + i, t, "user", f"long {t}") for i in range(3) for t in range(90 - i)]
    return [*out, *odd, *long]


@pytest.mark.parametrize("small", [False, True])
def test_nodes_are_those_of_all_prefixes(spark, monkeypatch, small):
    if small:  # many shards, bands within conversations, runs of few ids
        for name, value in (("SHARD", 40), ("BAND", 7), ("RUN", 4)):
            monkeypatch.setattr(conv_trie, name, value)
    turns = invented(5)
    df = spark.createDataFrame(turns, TURNS).withColumn("place", F.lit("mine")).withColumn("depth", F.lit(1))
    got = rows(conv_trie.trie(*conv_trie.with_family_heads(conv_trie.ordered(df.repartition(4)))))
    assert got == brute(rebuilt(turns))


def test_conversations_as_they_are_and_hot_beginnings(spark):
    """Not rebuilt: a third are copies of one conversation, and chains hang on chains of smaller ids."""
    hot = [(c, t, "user", f"same {t}") for c in range(40) for t in range(3)]
    nested = [(100 + c, t, "user", f"a{t}" if t < 20 - c else f"b{c}") for c in range(19) for t in range(21 - c)]
    turns = [*hot, *nested]
    said = defaultdict(list)
    for c, _, role, text in turns:
        said[c].append((role, text))
    ordered = conv_trie.ordered(spark.createDataFrame(turns, TURNS))
    got = rows(conv_trie.trie(ordered, conv_trie.lengths(ordered)))
    assert got == brute(said)


def test_turnless_conversations_end_at_the_root(spark):
    ordered = conv_trie.ordered(spark.createDataFrame([(3, 0, "user", "hi")], TURNS))
    convs = conv_trie.lengths(ordered).unionByName(spark.createDataFrame([(1, 0), (20, 0)], "conv_id BIGINT, n_turns BIGINT"))
    root, leaf = rows(conv_trie.trie(ordered, convs))
    digest = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    assert root == (1, 0, None, 3, 1, 1, 0, digest("1,20"))
    assert leaf == (3, 1, 1, 1, 0, 1, 0, digest("3"))


def test_no_conversations_no_nodes(spark):
    nothing = conv_trie.ordered(spark.createDataFrame([], TURNS))
    assert conv_trie.trie(*conv_trie.with_family_heads(nothing)).collect() == []


def test_a_shard_of_bits():
    columns = {
        "conv_id": [4, 4, 9, 9, 2], "place": [1, 2, 1, 2, 1], "f1": [7, 8, 7, 9, 7], "f2": [0, 0, 0, 0, 0],
        "size": [5, 1, 5, 2, 5], "s1": [0] * 5, "s2": [0] * 5, "n_turns": [2, 2, 2, 2, 1],
    }
    found = conv_trie.shard_nodes(pa.table(columns)).to_pylist()
    nodes = {(r["depth"], r["x1"]): (r["n"], r["conv_id"], r["size"], r["ends"], r["p1"]) for r in found}
    assert nodes == {(1, 7): (3, 2, 5, [2], 0), (2, 7 ^ 8): (1, 4, 1, [4], 7), (2, 7 ^ 9): (1, 9, 2, [9], 7)}
