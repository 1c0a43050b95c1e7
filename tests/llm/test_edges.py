"""Names that clash, ids that repeat, bounds of samples, and executors without the package."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tests.conftest import rows
from tomewise.llm import chat, decontam, labelled, language_id, lines, lsh_forest, mixing, quality, queries, substrings
from tomewise.llm.common import split_by_ids, table
from tomewise.llm.filter_audit import _local, _merger

DOCS = "doc_id BIGINT, text STRING"


def test_an_epoch_of_the_caller_comes_back(spark):
    df = spark.createDataFrame([(1, "d", "l", "s", 5, 77, "mine")], "doc_id BIGINT, domain STRING, lang STRING, source STRING, n_tokens BIGINT, epoch INT, tokens_taken STRING")
    (row,) = mixing.select_epochs(df, queries.MIX_LEVELS, {}, 5, ["doc_id"], max_epochs=1).collect()
    assert (row.input_epoch, row.input_tokens_taken, row.epoch, row.tokens_taken) == (77, "mine", 0, 5)


@pytest.mark.parametrize("key", ["rid", "n_words", "text_", "begin"])
def test_keys_of_substrings_may_have_any_name(spark, key):
    words = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, words), (2, words + " more")], DOCS).withColumnRenamed("doc_id", key)
    got = rows(substrings.remove_repeats(df, [key], 10))
    assert got == [(1, 20, 20, ""), (2, 21, 20, "more")]


def test_a_repeated_vector_id_has_one_vector(spark):
    data = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = rows(lsh_forest.nearest(df, df.filter("vec_id = 0")).select("query_id", "rank", "vec_id", "score"))
    # Id 0 is [0, 1], the first of its vectors.
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, pytest.approx(10**0.5))]


def test_a_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(7, f"text {i % 3}") for i in range(200)] + [(8, "other")], DOCS)
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id BIGINT, toxic INT")
    got = rows(labelled.sample(docs, labels, "toxic", (5, 9), {0: 10, 1: 10}))
    assert got == [(7, "text 0", 1), (8, "other", 0)]


def test_rows_that_are_surely_not_among_ids_are_set_apart(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("_word"), F.lit(1).alias("_bits"))
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    ids = spark.range(0, 5000, 50).select(F.col("id").alias("goes"))
    surely, others = split_by_ids(df, "doc_id", ids)
    assert surely.columns == others.columns == df.columns
    apart, doubt = ({r.doc_id for r in part.collect()} for part in (surely, others))
    assert apart | doubt == {None, *range(5000)} and not apart & doubt
    assert {r.goes for r in ids.collect()} <= doubt and None in apart and len(doubt) < 400
    nothing = split_by_ids(df, "doc_id", ids.limit(0))
    assert nothing[0].count() == 5001 and nothing[1].count() == 0


def test_the_64_copies_of_a_line_go_but_one(spark):
    df = spark.createDataFrame([(1, "\n".join(["same"] * 64 + ["last"]))], DOCS)
    (row,) = lines.remove_repeated_lines(df, min_lines=1).collect()
    assert (row.n_lines, row.n_removed, row.kept) == (65, 63, "same\nlast")


def test_a_hot_conversation_keeps_its_order(spark):
    turns = [(1, i // 2, "user", f"turn {i:04d}") for i in range(500)] + [(None, 1, "user", "x"), (None, 1, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    formatted = chat.format_chats(df, queries.TOKENIZER)
    got = formatted.orderBy("conv_id", "start").select("conv_id", "start", F.size("ids").alias("n")).collect()
    for conv in (None, 1):
        at = 0
        for r in (r for r in got if r.conv_id == conv):
            assert r.start == at
            at += r.n
    plan = formatted._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_workers_do_not_need_the_package(tmp_path):
    """Everything that is sent to a worker loads where the package cannot be imported."""
    index = decontam.Index([(1, "some words of a benchmark item", 3, 6)])
    model = language_id.model_of(["aa"], np.zeros(3, int), np.array([1, 2, 3], np.uint32), np.ones(3, int))
    found = lsh_forest.Queries(np.array([1]), np.zeros((1, 2)), np.zeros((1, 2), np.uint64))
    sent = [index, model, found, _local, _merger(True), decontam._searcher(None, 1, ["a"]), lsh_forest._scorer(None, 3)]
    (tmp_path / "sent").write_bytes(cloudpickle.dumps(sent))
    load = "import pickle, sys; pickle.load(open('sent', 'rb')); print('tomewise' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", load], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == ["False"], out.stderr


def test_scores_of_trees_are_those_of_walking_each(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, quality.N_STATISTICS))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.grow(x, y)

    def walk(tree: int, row: np.ndarray) -> float:
        node, inner = 0, model.feature.shape[1]
        while node < inner:
            node = 2 * node + 1 + (row[model.feature[tree, node]] > model.threshold[tree, node])
        return model.leaf[tree, node - inner]

    asked = rng.normal(size=(40, quality.N_STATISTICS))
    want = [1 / (1 + np.exp(-(model.base + sum(walk(t, row) for t in range(len(model.leaf)))))) for row in asked]
    assert np.allclose(model.score(asked), want, atol=1e-9)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_most_toxic_texts_are_found(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, sf_dir).filter("held_out").join(table(spark, sf_dir, "labels"), "doc_id")
    n = got.agg(F.sum("toxic"), F.sum("predicted"), F.sum(F.col("toxic") * F.col("predicted"))).first()
    assert n[2] >= 0.75 * n[0] and n[2] >= 0.9 * n[1]
