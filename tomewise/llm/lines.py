"""Removal of repeated runs of lines by a suffix array over line ids (operator 3).

The corpus is one sequence of line ids, cut at the ends of documents. Its suffixes are put in order by
prefix doubling: ranks by the first line, then by the first two, four and so on, each round from the pairs (rank here,
rank as many lines further on), ordered and numbered over the whole corpus by range partitions and prefix sums. Only suffixes
that share their rank with another go on, as the others are in their place already, so rounds get smaller. The last round
overlaps, so that ranks are by the first ``min_lines`` lines exactly: suffixes of equal rank are the intervals of the suffix
array with a longest common prefix of ``min_lines`` lines or more. In each interval the first in order of (doc_id, line) is
the original and the others are later copies; later copies in a row make a maximal repeated run. Every line
of a run goes.

So a line goes if and only if it is one of ``min_lines`` lines in a row that begin earlier in the corpus as well, where
the earlier place may overlap. Lines end at line breaks and are compared by 128 bits of hashes of all their characters.

A null text has no lines; an empty one has one empty line. Rows that repeat doc_id and text count as
one document and get the same result. A null doc_id comes first. Other columns are kept.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewise.llm.common import cut
from tomewise.operators.ordering import number_rows

MIN_LINES = 3


def _shared(df: DataFrame, key: list[str]) -> DataFrame:
    """The different values of ``key`` that several places have; repeated rows are one place."""
    place = F.struct("rid", "line")
    several = df.groupBy(*key).agg(F.min(place).alias("_a"), F.max(place).alias("_b"))
    return several.filter(F.col("_a") != F.col("_b")).select(*key)


def _beside(ranks: DataFrame, lines: int) -> DataFrame:
    """Each suffix with its rank as ``a`` and that of the suffix ``lines`` further on as ``b``."""
    after = ranks.select("rid", (F.col("line") - lines).alias("line"), F.col("rank").alias("b")).distinct()
    return ranks.withColumnRenamed("rank", "a").join(after, ["rid", "line"])


def _next_ranks(pairs: DataFrame) -> DataFrame:
    """Ranks of the pairs (a, b) among all that several suffixes have; other suffixes are done."""
    pairs = cut(pairs)
    numbered = number_rows(_shared(pairs, ["a", "b"]), ["a", "b"], "rank")
    return cut(pairs.join(numbered, ["a", "b"]).select("doc_id", "rid", "line", "rank"))


def repeated_suffixes(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, rid, line, rank) of the suffixes of ``lines (doc_id, rid, line, id)`` that share at least
    ``min_lines`` lines with another; ``rank`` is equal for those that share them."""
    again = _shared(lines, ["id"])
    ranks = cut(lines.join(again, "id").select("doc_id", "rid", "line", F.col("id").alias("rank")))
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        ranks = _next_ranks(_beside(ranks, step))
        depth += step
    return ranks


def later_copies(suffixes: DataFrame) -> DataFrame:
    """The suffixes of each interval but its first."""
    place = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("rid"), F.col("line"))
    first = suffixes.groupBy("rank").agg(F.min(place).alias("first"))
    return suffixes.join(first, "rank").filter(place != F.col("first")).select("rid", "line")


def runs(copies: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(rid, begin, lines): maximal repeated runs from the lines at which later copies begin."""
    by_line = Window.partitionBy("rid").orderBy("line")
    gap = F.col("line") - F.lag("line").over(by_line)
    # Copies that begin within a run make it longer; others begin one.
    new = F.when(gap.isNull() | (gap > min_lines), 1).otherwise(0)
    return (
        copies.withColumn("_new", new)
        .withColumn("_run", F.sum("_new").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "_run")
        .agg(F.min("line").alias("begin"), (F.max("line") - F.min("line") + min_lines).cast("int").alias("lines"))
        .drop("_run")
    )


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs (doc_id, text, ...)`` with ``n_lines``, ``n_removed`` and ``kept``, the text that is left. Columns
    that already have one of these names are replaced."""
    own = {"doc_id", "text", "n_lines", "n_removed", "kept"}
    others = [c for c in docs.columns if c not in own]
    packed = [F.struct(*others).alias("others")] if others else []
    # Two hashes each: one is too few to tell 10^12 lines apart.
    rid = F.struct(F.xxhash64("doc_id", "text").alias("x"), F.xxhash64(F.lit("row"), "text", "doc_id").alias("y"))
    docs = docs.select("doc_id", "text", *packed, rid.alias("rid"))
    split = F.split("text", "\n", -1)
    line = lambda x: F.struct(F.xxhash64(x).alias("x"), F.xxhash64(F.lit("line"), x).alias("y"))
    ids = docs.select("doc_id", "rid", F.posexplode(F.transform(split, line)).alias("line", "id"))
    lines = cut(ids)
    found = runs(later_copies(repeated_suffixes(lines, min_lines)), min_lines)
    # At most as many runs as the document has lines.
    per_doc = found.groupBy("rid").agg(F.collect_list(F.struct("begin", "lines")).alias("runs"))
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["begin"], r["begin"] + r["lines"] - 1)))
    all_lines = F.coalesce(split, F.array().cast("array<string>"))
    n = F.size(all_lines)
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    left = F.when(F.col("runs").isNull(), numbers).otherwise(F.array_except(numbers, gone))
    kept = F.array_join(F.transform(left, lambda i: F.element_at(all_lines, i + 1)), "\n")
    return (
        docs.join(per_doc, "rid", "left")
        .withColumn("n_lines", n)
        .withColumn("n_removed", n - F.size(left))
        .withColumn("kept", kept)
        .select("doc_id", "text", *(["others.*"] if others else []), "n_lines", "n_removed", "kept")
    )
