"""Bounded samples of labelled documents, and folds by crc32 of the document id."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import cut


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into one part of several; not for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], per_class: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class[value]`` labelled documents of each value, without
    those of the held-out fold: the first by a hash of the id. Written down, since fits read it often.

    The bound is on the number of rows, and so what is broadcast and collected is bounded too. An id
    that has several labels takes the lowest; null ids and labels are left out.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", *fold))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"))
    )
    drawn = None
    for value, most in per_class.items():
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = some if drawn is None else drawn.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    drawn = cut(drawn)
    # A drawn id may stand on any number of rows: one of them, the first by its text, is in the sample. Texts move only then.
    ids = texts.select("doc_id").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeats = cut(ids.filter(F.col("n") > 1).select("doc_id"))
    rows = texts.join(F.broadcast(drawn), "doc_id")
    if repeats.isEmpty():
        return cut(rows)
    again = rows.join(F.broadcast(repeats), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    once = rows.join(F.broadcast(repeats), "doc_id", "left_anti").select("doc_id", "text", "label")
    return cut(once.unionByName(again.select("doc_id", "text", "label")))
