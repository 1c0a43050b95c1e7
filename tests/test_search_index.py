"""BM25 against a loop over documents, and what a search reads."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tomewise.operators.search_index import B, K1, build_index, folder_of, search_index, search_many

DOCS = [
    (1, "The hot ring"), (2, "ring ring RING of fire"), (3, "Über-Ring, 7. Band"), (4, ""), (5, None), (6, "   !? "),
    (7, "cold plate"), (8, "hot plate and hot ring"), (9, "日本 ring"), (9, "日本 ring"), (None, "nobody's ring"),
]
WORD = re.compile(r"[^\W_]+")


def brute(query):
    docs = {i: WORD.findall((t or "").lower()) for i, t in DOCS if i is not None}
    average = sum(map(len, docs.values())) / len(docs)
    out = {}
    for word in set(WORD.findall(query.lower())):
        having = [i for i in docs if word in docs[i]]
        idf = math.log(1 + (len(docs) - len(having) + 0.5) / (len(having) + 0.5))
        for i in having:
            tf = Counter(docs[i])[word]
            out[i] = out.get(i, 0) + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(docs[i]) / average))
    return sorted(out.items(), key=lambda r: (-r[1], r[0]))


@pytest.fixture(params=[65_536, 2], ids=["one block", "many blocks"])
def index(spark, tmp_path, request):
    build_index(spark.createDataFrame(DOCS, "id INT, text STRING"), f"{tmp_path}/index", postings=request.param, folders=4)
    return f"{tmp_path}/index"


@pytest.mark.parametrize("query", ["hot ring", "RING", "ring hot ring", "über 日本", "nothing there", "", "?!"])
def test_scores_are_those_of_a_loop(spark, index, query):
    got = [(r.id, r.score) for r in search_index(spark, index, query).collect()]
    want = brute(query)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-12 for g, w in zip(got, want))


def test_many_queries_at_once(spark, index):
    asked = [(1, "hot ring"), (2, "plate"), (3, None), (4, "absent")]
    got = search_many(spark, index, spark.createDataFrame(asked, "query_id INT, text STRING"), 2).collect()
    want = [(q, n, i) for q, text in asked for n, (i, _) in enumerate(brute(text or "")[:2], 1)]
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == want


def test_a_search_reads_the_postings_of_its_words(spark, index):
    found = search_index(spark, index, "plate")
    plan = found._jdf.queryExecution().toString()
    folder = spark.range(1).select(folder_of(F.lit("plate"), 4)).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*folder#\d+ = {folder}", plan)
    assert "EqualTo(term,plate)" in plan
    assert len({re.search(r"folder=(\d+)", f)[1] for f in found.sparkSession.read.parquet(f"{index}/postings").filter(f"folder = {folder}").inputFiles()}) >= 1


def test_no_documents(spark, tmp_path):
    build_index(spark.createDataFrame([], "id INT, text STRING"), f"{tmp_path}/index")
    assert search_index(spark, f"{tmp_path}/index", "ring").collect() == []
