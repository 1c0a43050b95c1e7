"""Language identification: code lengths against a coder that walks contexts byte by byte, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tomewise.llm import language_id, queries
from tomewise.llm.common import table
from tomewise.llm.language_id import ORDER, Index

DOCS = "doc_id BIGINT, lang STRING, text STRING"


def followers(texts):
    """Counts of the bytes behind each context of up to ORDER bytes."""
    seen = defaultdict(Counter)
    for text in texts:
        data = bytes(ORDER) + text.encode()
        for i in range(ORDER, len(data)):
            for k in range(ORDER + 1):
                seen[data[i - k : i]][data[i]] += 1
    return seen


def brute_bits(seen, text):
    data, bits = bytes(ORDER) + text.encode(), 0.0
    for i in range(ORDER, len(data)):
        for k in range(ORDER, -1, -1):
            here = seen.get(data[i - k : i])
            if not here:
                continue
            n, different = sum(here.values()), len(here)
            if data[i] in here:
                bits -= math.log2(here[data[i]] / (n + different))
                break
            bits -= math.log2(different / (n + different))
        else:
            bits += 8
    return bits


def invented(seed, letters, n=40):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 8))) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


TEXTS = {"aa": invented(1, "abcdeé"), "bb": invented(2, "defgß"), "cc": invented(3, "日本xyz")}
ODD = ["", "a", "é", "\x00\x00\x00a", "abc 日本 unseen Ω", "x" * 3000, "\U0001f600" * 5, "a\n\tb"]


def trained(spark, fold=(4, 9)):
    known = [(i * 10 + j, lang, t) for i, (lang, texts) in enumerate(TEXTS.items(), 1) for j, t in enumerate(texts, 100 * i)]
    df = spark.createDataFrame(known, DOCS)
    return language_id.fit(df, fold), df


def test_code_lengths_are_those_of_a_coder_that_walks(spark):
    model, _ = trained(spark)
    assert model.langs == sorted(TEXTS)
    trees = [followers(TEXTS[lang]) for lang in model.langs]
    asked = [*ODD, *invented(7, "abcdefgxyz", 10)]
    got = model.lengths(pa.array(asked))
    want = [[brute_bits(tree, text) for tree in trees] for text in asked]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_predictions_and_scores(spark):
    model, _ = trained(spark)
    texts = [(1, "xx", None), (2, None, ""), (3, None, "123 !?"), (None, "aa", "abba"), (5, "bb", "gßg fed"), (5, "bb", "gßg fed"), (6, None, "日本")]
    df = spark.createDataFrame(texts, DOCS).withColumn("score", F.lit("mine"))
    got = rows(df.select("doc_id", language_id.predict(model, "text").alias("t")).select("doc_id", "t.lang_pred", "t.score"))
    assert [r[:2] for r in got] == [(None, "aa"), (1, "und"), (2, "und"), (3, "und"), (5, "bb"), (5, "bb"), (6, "cc")]
    assert [r[2] for r in got if r[1] == "und"] == [0.0] * 3 and all(1 / 3 <= r[2] <= 1 for r in got if r[1] != "und")


def test_the_first_of_equal_languages_and_nothing_learnt(spark):
    same = [(i, lang, "same words here") for i, lang in enumerate(["nn", "mm"])]
    model = language_id.fit(spark.createDataFrame(same, DOCS), (4, 9))
    told = spark.createDataFrame([("same",)], "text STRING").select(language_id.predict(model, "text").alias("t")).first().t
    assert (told.lang_pred, told.score) == ("mm", 0.5)
    for rows_ in ([], [(None, "aa", "text"), (1, None, "text"), (2, "aa", None)]):
        assert language_id.fit(spark.createDataFrame(rows_, DOCS), (4, 9)) is None
    told = spark.createDataFrame([("text",)], "text STRING").select(language_id.predict(None, "text").alias("t")).first().t
    assert (told.lang_pred, told.score) == ("und", 0.0)


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANG", 5)
    monkeypatch.setattr(language_id, "LANG_BYTES", 50)
    hot = [(7, "aa", "hot " * 5)] * 300 + [(i, "aa", "word " * 4) for i in range(100, 200)] + [(1, "bb", "only")]
    drawn = rows(language_id._sample(spark.createDataFrame(hot, DOCS), (4, 9)))
    assert 1 <= sum(r[0] == "aa" for r in drawn) <= 3 and ("bb", "only") in drawn


def test_the_held_out_fold_teaches_nothing(spark):
    docs = spark.createDataFrame([(i, f"l{i}", f"text {i}") for i in range(40)], DOCS)
    model = language_id.fit(docs, (4, 2))
    held = {r.lang for r in docs.filter(language_id.held_out("doc_id", 4, 2)).collect()}
    assert held and set(model.langs) == {f"l{i}" for i in range(40)} - held


def test_every_key_of_an_index_is_found():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 4000):
        keys = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64)).astype(np.uint32)
        index = Index(keys)
        others = np.setdiff1d(rng.integers(0, 1 << 32, 500, dtype=np.uint64).astype(np.uint32), keys)
        assert index.find(keys).tolist() == list(range(len(keys)))
        assert (index.find(others) == -1).all()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_documents_get_their_language(spark, sf):
    told = queries.op12_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right = told.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    least = told.filter("held_out").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("r"))
    assert right >= 0.98 and least.agg(F.min("r")).first()[0] >= 0.95
