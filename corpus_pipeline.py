"""A training corpus from raw documents: each stage is written down and read again by the next.

1. quality: documents that the quality classifier rejects go.
2. near duplicates: of each group of documents that are alike in their shingles of five words (at 0.8 or more) the one
   with the smallest id stays, with one row of each different text that has this id; rows without an id stay.
3. decontamination: documents that hold a benchmark item, but for a few edits, go.
4. mixing: each (domain, language, source) gets its share of a token budget, and its documents are taken in a
   seeded order until the share is met. Nothing is taken twice here (one epoch), and the document in which a share ends
   is kept whole.
5. token files: the ids of all texts that are left, as files; a row per document says where its ids are.

Every stage keeps the columns of its input, whatever they are called; the last returns what it wrote.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.llm import decontam, jaccard, mixing, quality, queries, token_files
from tomewise.llm.common import cut, cut_at, drop_table, read_texts, split_by_ids, table
from tomewise.session import fresh_dir

MIX_SHARE, MIX_EPOCHS = (9, 10), 1
QUALITY_FOLD = (4, 2)
NEAR_PERCENT, NEAR_WORDS = 80, 5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read_texts(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold=QUALITY_FOLD)
    return docs.filter(quality.score(model, "text") >= quality.ACCEPT)


def near_duplicates(
    spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = jaccard.PERCENT, words: int = jaccard.WORDS
) -> DataFrame:
    found = cut(jaccard.groups(docs, percent, words))
    # The ids that go, or that stay but repeat, are few beside the documents. Documents that are surely none of them
    # stay where they are; only the others move to be joined.
    goes = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("goes"))
    repeats = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    repeats = cut(repeats.filter(F.col("rows") > 1).select(F.col("doc_id").alias("goes")))
    listed = cut(goes.unionByName(repeats).distinct())
    surely, others = split_by_ids(docs, "doc_id", listed)
    number = others["doc_id"].cast("long")
    kept = surely.unionByName(others.join(listed, number == F.col("goes"), "left_anti"))
    if repeats.isEmpty():
        return kept
    again = others.join(repeats, number == F.col("goes"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(again)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read_texts(spark)
    return near_duplicates(spark, docs, sf_dir, NEAR_PERCENT, NEAR_WORDS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read_texts(spark)
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read_texts(spark)
    leaves = docs.select(
        F.struct("*").alias("row"),
        "doc_id",
        queries.domain_of("source").alias("domain"),
        "lang",
        "source",
        mixing.word_tokens("text").alias("n_tokens"),
    )
    taken = mixing.select_epochs(
        leaves, queries.MIX_LEVELS, queries.MIX_WEIGHTS, MIX_SHARE, ["doc_id"],
        max_epochs=MIX_EPOCHS, seed=queries.MIX_SEED,
    )
    return taken.select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    read_texts(spark)
    path = fresh_dir(spark, "tokens")
    return token_files.read_token_files(token_files.write_token_files(docs, path, queries.TOKENIZER), path)


STAGES = [
    ("quality", good_quality),
    ("near duplicates", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token files", token_output),
]

# A grown model and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = cut_at(stage(spark, docs, sf_dir))
        if before:
            drop_table(spark, before)
        before = path
    # The token files hold what is returned; they are written before this ends, so the last input can go as well.
    result = STAGES[-1][1](spark, docs, sf_dir)
    drop_table(spark, before)
    return result
