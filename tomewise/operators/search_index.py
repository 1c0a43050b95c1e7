"""Ranked search: an inverted index as a table, and BM25 over it.

The index of a folder has two tables. ``postings`` has a row per term and block, with the ids of the documents that hold the
term, how often each does, and how long each is; a term that many documents share has several blocks, so no row
is larger than ``POSTINGS`` entries on average. It is partitioned by a hash of the term and sorted by term, so a search opens
the folders of its terms and, in them, reads the row groups that can hold them. ``totals`` has the numbers of documents and words.

A word is a run of letters and digits in lower case. The score of a document is the sum over the query's different words of

    ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length)).

A document without words is counted and never found. Documents are told apart by id: rows that repeat one are one document.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewise.session import cut

WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
POSTINGS, FOLDERS = 65_536, 64


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def folder_of(term: str | Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def build_index(documents: DataFrame, path: str, postings: int = POSTINGS, folders: int = FOLDERS) -> None:
    """Write the index of ``documents (id, text)``."""
    named = documents.filter("id IS NOT NULL").select("id", words(F.col("text")).alias("words"))
    once = cut(named.groupBy("id").agg(F.max("words").alias("words")))
    counted = once.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", "id", "length")
    entries = cut(counted.agg(F.count(F.lit(1)).cast("int").alias("tf")))
    frequency = entries.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / postings)).cast("int")
    placed = entries.join(frequency, "term").withColumn("block", block)
    rows = placed.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("entries"))
    rows = rows.withColumn("folder", folder_of("term", folders))
    by_folder = rows.repartition(F.col("folder"), F.col("block")).sortWithinPartitions("folder", "term", "block")
    by_folder.write.partitionBy("folder").parquet(f"{path}/postings")
    totals = once.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size("words")), F.lit(0)).cast("long").alias("words"))
    kind = documents.schema["id"].dataType.simpleString()
    totals.withColumns({"folders": F.lit(folders), "id_type": F.lit(kind)}).write.parquet(f"{path}/totals")


def _scores(found: DataFrame, asked: DataFrame | None, totals, keys: list[str]) -> DataFrame:
    """Scores of the documents in ``found (term, entries)``, for one query or for those that ``asked`` for a term."""
    # One row per term; the blocks of a term know their sizes without being opened.
    rarity = found.groupBy("term").agg(F.sum(F.size("entries")).alias("df"))
    idf = F.log(1 + (F.lit(totals.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = rarity.select("term", idf.alias("idf"))
    if asked is not None:
        weighted = asked.join(weighted, "term")
    average = totals.words / max(totals.documents, 1)
    entry = found.join(weighted, "term").select(*keys[:-1], "idf", F.explode("entries").alias("e"))
    tf, norm = F.col("e.tf"), 1 - B + B * F.col("e.length") / F.lit(average)
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * norm)
    return entry.select(*keys[:-1], F.col("e.id").alias("id"), part.alias("part")).groupBy(*keys).agg(F.sum("part").alias("score"))


def _totals(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/totals").first()


def _postings(spark: SparkSession, path: str, totals) -> DataFrame:
    entry = f"STRUCT<id: {totals.id_type}, tf: INT, length: INT>"
    return spark.read.schema(f"term STRING, block INT, entries ARRAY<{entry}>, folder INT").parquet(f"{path}/postings")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id, score) of every document that holds a word of the query, best first, equal scores by id."""
    totals = _totals(spark, path)
    asked = spark.range(1).select(F.explode(F.array_distinct(words(F.lit(query)))).alias("term"))
    terms = asked.select("term", folder_of("term", totals.folders).alias("folder")).collect()
    postings = _postings(spark, path, totals)
    here = F.col("folder").isin([t.folder for t in terms]) & F.col("term").isin([t.term for t in terms])
    return _scores(postings.filter(here), None, totals, ["id"]).orderBy(F.desc("score"), "id")


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best documents of every query in ``queries (query_id, text)``."""
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct()
    totals = _totals(spark, path)
    found = _postings(spark, path, totals).join(asked.select("term").distinct(), "term", "left_semi")
    scored = _scores(found, asked, totals, ["query_id", "id"])
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
