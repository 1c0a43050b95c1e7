"""Registered queries of search, stored recommendations, ranking quality, sketches and stream state."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.operators import core, quality, ranking, recommend, search_index, sketches, split, stats
from tomewise.operators.topk import best_items
from tomewise.operators.topk_pruned import best_items_pruned
from tomewise.plans import derived, model
from tomewise.plans.queries import (
    SCORE_DECIMALS, SERVED_ALS, _fixed_recs, _rating_table, als_tuned,
)
from tomewise.plans.recommend_job import JobConfig, recommend_job
from tomewise.schemas import RATINGS, USERS, conform, ensure_tables, rows
from tomewise.session import cut, fresh_dir
from tomewise.sources import bucketed, tables, xmlbooks
from tomewise.streaming import latest
from tomewise.streaming.refresh import read_rating_files

SEARCHED, TITLES_FOUND = "hot ring by brand#7", 10
CORE_BOOKS, CORE_USERS = 27, 19
METRIC_CUTOFFS, RELEVANT = (5, 10), 4.0
PRUNED_BLOCK = 64


# Search


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    books, path = derived.books(spark, sf_dir), fresh_dir(spark, "index")
    text = F.concat_ws(" ", "title", "author").alias("text")
    search_index.build_index(books.select(F.col("ext_book_id").alias("id"), text), path)
    return books, path


def book_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book that holds a word of the query in its title or author, best first."""
    books, path = _index(spark, sf_dir)
    found = search_index.search_index(spark, path, SEARCHED).withColumnRenamed("id", "ext_book_id")
    shown = found.join(books.select("ext_book_id", "title", "author"), "ext_book_id")
    return shown.select("ext_book_id", "title", "author", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "ext_book_id")


def book_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best books for each title of the catalogue as a query."""
    books, path = _index(spark, sf_dir)
    asked = books.groupBy(F.col("title").alias("text")).agg(F.min("ext_book_id").alias("query_id"))
    found = search_index.search_many(spark, path, asked.filter("text IS NOT NULL"), TITLES_FOUND)
    return found.select("query_id", "rank", F.col("id").alias("ext_book_id"), F.round("score", 6).alias("score"))


# Recommendations at rest


def _stored(spark: SparkSession, df: DataFrame, kind: str, sort_by: list[str], buckets: int) -> DataFrame:
    name, path = f"{kind}_{uuid.uuid4().hex}", fresh_dir(spark, kind)
    return bucketed.write_bucketed(df, name, path, "user_id", buckets, sort_by)


def stored_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = cut(_fixed_recs(spark, sf_dir))
    return _stored(spark, recs, "recs", ["user_id"], bucketed.buckets_for(recs.count()))


def one_user_recs_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user from the stored table: one bucket is read."""
    return stored_recs(spark, sf_dir).filter(F.col("user_id") == 42)


def recs_known_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored recommendations with the user's own rating, from ratings that are stored by user as well."""
    recs, ratings = cut(_fixed_recs(spark, sf_dir)), cut(derived.ratings(spark, sf_dir))
    # As many buckets for the one as for the other, for the larger of the two.
    buckets, order = bucketed.buckets_for(ratings.count()), ["user_id", "book_id"]
    return bucketed.join_buckets(
        _stored(spark, recs, "recs", order, buckets), _stored(spark, ratings, "ratings", order, buckets), order
    )


def fixed_factor_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = derived.factors(spark, sf_dir)
    best, _ = best_items_pruned(vectors, vectors, 10, decimals=SCORE_DECIMALS, items_per_block=PRUNED_BLOCK)
    return best.select("user_id", "book_id", "prediction")


def fixed_factor_pruned_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = derived.factors(spark, sf_dir)
    seen = derived.ratings(spark, sf_dir)
    best, _ = best_items_pruned(vectors, vectors, 10, seen=seen, decimals=SCORE_DECIMALS, items_per_block=PRUNED_BLOCK)
    return best.select("user_id", "book_id", "prediction")


# Quality of rankings, and of the ratings they rest on


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recommendations that leave out the training part, and the test part."""
    training, _, test = split.by_hash(cut(derived.ratings(spark, sf_dir)), seed=7)
    vectors = derived.factors(spark, sf_dir)
    recs = best_items(vectors, vectors, 10, seen=training, decimals=SCORE_DECIMALS)
    # Each metric reads the test part several times: it is split off and written once.
    return cut(recs.select("user_id", "book_id", "prediction")), cut(test)


def ranking_metrics_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs, test = _judged(spark, sf_dir)
    found = None
    for k in METRIC_CUTOFFS:
        row = ranking.ranking_metrics(recs, test, k, RELEVANT)
        found = row if found is None else found.unionByName(row)
    return found.select("k", "users", "judged", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "map", "ndcg")])


def ranking_metrics_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = ranking.per_user(*_judged(spark, sf_dir), METRIC_CUTOFFS[-1], RELEVANT)
    metrics = ("precision", "recall", "average_precision", "ndcg")
    return each.select("user_id", "relevant", "hits", *[F.round(m, 6).alias(m) for m in metrics])


def active_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.active_core(cut(derived.ratings(spark, sf_dir)), CORE_BOOKS, CORE_USERS)


# Sketches


def rating_counts_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per day of rating, written down and merged: the exact numbers, and whether the estimates are within the
    stated error of them."""
    ratings = cut(derived.ratings_raw(spark, sf_dir))
    days = cut(sketches.sketch_counts(ratings, F.to_date("o_orderdate")))
    found = sketches.estimates(sketches.merge_counts(days))
    exact = stats.characteristics(ratings)
    told = found.select(
        F.expr("stack(3, '# of Ratings', ratings, '# of Users', users, '# of Books', books) AS (characteristic, estimate)")
    )
    near = F.abs(F.col("estimate") - F.col("count")) <= sketches.COUNT_ERROR * F.col("count")
    return exact.join(told, "characteristic").select("characteristic", "count", near.alias("within_error"))


def price_quantiles_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per ship date, written down and merged: whether the rank of each quantile is within the stated error."""
    lines = derived.table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_shipdate")
    days = cut(sketches.sketch_quantiles(lines, "l_extendedprice", F.to_date("l_shipdate")))
    told = sketches.quantiles_of(sketches.merge_quantiles(days), (0.01, 0.25, 0.5, 0.75, 0.99))
    # Five values meet all prices.
    ranks = lines.join(F.broadcast(told)).groupBy("prob").agg(
        F.count("l_extendedprice").alias("n"),
        F.count_if(F.col("l_extendedprice") < F.col("value")).alias("below"),
        F.count_if(F.col("l_extendedprice") <= F.col("value")).alias("upto"),
    )
    low, high = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    near = (low - F.col("prob") <= sketches.RANK_ERROR) & (F.col("prob") - high <= sketches.RANK_ERROR)
    return ranks.select("prob", F.col("n").alias("prices"), near.alias("within_error"))


# Tables, views and rows in memory


def users_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users in a table that is made if it is not there, twice: the second time changes nothing."""
    database = f"shop_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh_dir(spark, 'database')}'")
    ensure_tables(spark, database=database)
    conform(derived.users(spark, sf_dir), USERS).write.insertInto(f"{database}.users")
    ensure_tables(spark, database=database)
    return spark.table(f"{database}.users")


def rating_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a view over the ratings."""
    name = f"ratings_{uuid.uuid4().hex}"
    tables.register_view(derived.ratings(spark, sf_dir), name)
    return tables.preview(spark.sql(f"SELECT * FROM {name} ORDER BY user_id, book_id"))


def users_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, and one more for every nation, from rows in memory."""
    nations = [(-r.n_nationkey - 1, r.n_name) for r in derived.table(spark, sf_dir, "nation").collect()]
    return derived.users(spark, sf_dir).unionByName(rows(spark, nations, USERS))


def best_point_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best point of a grid whose errors are those of predicting each line's mean quantity."""
    lines = derived.table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber").cast("int"))
    metrics = lines.groupBy(F.col("line").alias("grid_pos")).agg(
        (F.max("line") * 10).cast("int").alias("rank"),
        (F.max("line") / 20).alias("reg"),
        F.round(F.stddev_pop("l_quantity"), 6).alias("rmse"),
        F.count(F.lit(1)).alias("scored"),
    )
    return model.best_point(metrics)


def ratings_load_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one table, and a third that brings row ids which are taken: it is refused as a whole."""
    path, full = fresh_dir(spark, "ratings"), cut(_rating_table(spark, sf_dir))
    even, odd = full.filter("col_id % 2 = 0"), full.filter("col_id % 2 = 1")
    tables.append_ratings(even, path)
    there = spark.read.schema(RATINGS).parquet(path)
    tables.append_ratings(odd, path, there)
    try:
        tables.append_ratings(odd.limit(1).unionByName(even.withColumn("col_id", -F.col("col_id"))), path, spark.read.schema(RATINGS).parquet(path))
    except tables.DuplicateKey:
        return spark.read.schema(RATINGS).parquet(path)
    raise AssertionError("row ids that are taken were loaded")


def _drifting_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book payloads in four shapes: as they are, wrapped, with an attribute on the id, with authors as plain text."""
    lookup = derived.gr_books(spark, sf_dir).select("ext_book_id", "isbn10")
    payload, shape = xmlbooks.book_payload(), F.col("ext_book_id") % 4
    plain = F.regexp_replace(F.regexp_replace(payload, "<author><name>", "<author>"), "</name></author>", "</author>")
    shaped = (
        F.when(shape == 1, F.concat(F.lit("<response>"), payload, F.lit("</response>")))
        .when(shape == 2, F.regexp_replace(payload, "<id>", '<id type="integer">'))
        .when(shape == 3, plain)
        .otherwise(payload)
    )
    return derived.books(spark, sf_dir).join(lookup, "ext_book_id").select(shaped.alias("payload"))


def xml_books_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xmlbooks.parse_drifting_books(_drifting_payloads(spark, sf_dir)).drop("description")


def xml_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many payloads there are, and whether the schema found for them knows the ways in which they differ."""
    found = xmlbooks.payload_shape(_drifting_payloads(spark, sf_dir))
    shape = F.col("shape")
    drifts = shape.contains("book: OBJECT<") & shape.contains("id: VARIANT") & shape.contains("author: VARIANT")
    return found.select("payloads", drifts.alias("drifts"))


# What can be said of trained models


def _per_user(spark: SparkSession, sf_dir: str, recs: DataFrame) -> DataFrame:
    known = recommend.with_known_rating(recs, derived.ratings(spark, sf_dir))
    return known.groupBy("user_id").agg(F.count(F.lit(1)).alias("recs"), F.count("rating").alias("rated"))


def als_tuned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_user(spark, sf_dir, als_tuned(spark, sf_dir))


def als_train_scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that never saw the holdouts: users and books of the training part only."""
    config = JobConfig(als=SERVED_ALS, fit_on="train")
    return _per_user(spark, sf_dir, recommend_job(derived.ratings(spark, sf_dir), config))


def als_subset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations per user of those who rated at least 30 books; rated ones are not left out."""
    ratings = cut(derived.ratings(spark, sf_dir))
    fitted = model.fit(ratings, SERVED_ALS.for_ratings(ratings.count()))
    return recommend.top_n_for(fitted, quality.active_users(ratings, 30)).groupBy("user_id").agg(F.count(F.lit(1)).alias("recs"))


# Streaming


def stream_latest_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rating of every user and book, from three deliveries that overlap in time, each by a run of its own."""
    path = fresh_dir(spark, "latest")
    events = derived.table(spark, sf_dir, "events")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", latest.STATE_STORE)
    try:
        for each in (2, 0, 1):
            events.filter(F.col("event_id") % 3 == each).write.mode("append").parquet(f"{path}/landing")
            stream = derived.new_ratings(read_rating_files(spark, f"{path}/landing", events.schema))
            latest.keep_newest_ratings(stream, f"{path}/newest", f"{path}/checkpoint", "60 days", 90 * 86_400_000).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return latest.latest(spark, f"{path}/newest").select("username", "ext_book_id", "rating", "arrival")


QUERIES = {
    run.__name__: run
    for run in (
        book_search_ranked,
        book_search_top,
        one_user_recs_stored,
        recs_known_stored,
        fixed_factor_pruned,
        fixed_factor_pruned_unseen,
        ranking_metrics_fixed,
        ranking_metrics_per_user,
        active_core,
        rating_counts_sketched,
        price_quantiles_sketched,
        users_table,
        rating_preview,
        users_with_rows,
        best_point_of,
        ratings_load_refused,
        xml_books_variant,
        xml_shape,
        als_tuned_counts,
        als_train_scope_counts,
        als_subset_counts,
        stream_latest_rating,
    )
}
