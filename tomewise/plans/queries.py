"""The registered queries: every operator over the derived tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.functions.book_columns import byline, lookup_url
from tomewise.operators import quality, recommend, serve, split, stats, upsert
from tomewise.operators.foldin import fold_in
from tomewise.operators.ordering import number_rows
from tomewise.operators.topk import best_items
from tomewise.plans import derived, model
from tomewise.plans.recommend_job import JobConfig, recommend_job
from tomewise.schemas import RATINGS, conform
from tomewise.session import cut, fresh_dir
from tomewise.sources import files, tables, xmlbooks
from tomewise.streaming.foldin import FoldInRefresh
from tomewise.streaming.refresh import Refresh, read_rating_files, start, without_redelivery

SCORE_DECIMALS = 6
PAGE = 20
SERVED_ALS = model.AlsConfig(seed=7)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.new_ratings(derived.table(spark, sf_dir, "events"))


def _directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.users(spark, sf_dir).select(F.col("id").alias("user_id"), "username")


def _economy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup that lacks some books, so that there is something to register."""
    economy = derived.table(spark, sf_dir, "part").filter(F.col("p_type") == "ECONOMY")
    ids = economy.select(F.col("p_partkey").cast("int").alias("gr_id"))
    return derived.gr_books(spark, sf_dir).join(ids, "gr_id", "left_semi")


def _rating_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ratings with row ids, usernames and ISBNs."""
    numbered = number_rows(derived.ratings(spark, sf_dir), ["user_id", "book_id"], "col_id")
    names = _directory(spark, sf_dir)
    isbns = derived.gr_books(spark, sf_dir).select(F.col("gr_id").alias("book_id"), "isbn10")
    full = numbered.join(names, "user_id", "left").join(isbns, "book_id", "left")
    return conform(full, RATINGS)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.catalog(
        derived.gr_books(spark, sf_dir), derived.books(spark, sf_dir), derived.DEFAULT_COVER
    )


def _fixed_recs(
    spark: SparkSession, sf_dir: str, seen: DataFrame | None = None, users: DataFrame | None = None
) -> DataFrame:
    """Recommendations for all users, or only for ``users (id)``: the others are not scored."""
    vectors = derived.factors(spark, sf_dir)
    asked = vectors if users is None else vectors.join(users, "id", "left_semi")
    return best_items(asked, vectors, 10, seen=seen, decimals=SCORE_DECIMALS).select(
        "user_id", "book_id", "prediction"
    )


# Statistics


def rating_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.characteristics(derived.ratings(spark, sf_dir))


def rating_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.describe(derived.ratings(spark, sf_dir))


def price_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a column with many different values."""
    return stats.describe(derived.table(spark, sf_dir, "lineitem"), "l_extendedprice", decimals=3)


def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(derived.ratings(spark, sf_dir))


def rating_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sparsity(derived.ratings(spark, sf_dir))


def rating_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.mean_and_mode(derived.ratings(spark, sf_dir))
    return found.withColumn("mean_rating", F.round("mean_rating", 6))


def top_rated_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _catalog(spark, sf_dir).select("book_id", "title")
    best = stats.top_rated(derived.ratings(spark, sf_dir), titles, k=5, min_ratings=3)
    return best.withColumn("avg_rating", F.round("avg_rating", 6))


def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.active_users(derived.ratings_raw(spark, sf_dir), 10)


def rmse_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of predicting every rating by its user's mean."""
    ratings = derived.ratings(spark, sf_dir)
    means = ratings.groupBy("user_id").agg(F.avg("rating").alias("prediction"))
    return stats.rmse(ratings.join(means, "user_id")).withColumn("rmse", F.round("rmse", 6))


# Loads and views


def dedupe_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.ratings(spark, sf_dir)


def union_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = ingest_ratings(spark, sf_dir).select("user_id", "book_id", "rating")
    return quality.union_ratings(derived.ratings(spark, sf_dir), added)


def ratings_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating table through a CSV file, read by position, checked and appended."""
    csv, table = fresh_dir(spark, "ratings-csv"), fresh_dir(spark, "ratings")
    _rating_table(spark, sf_dir).write.option("header", True).csv(csv)
    tables.append_ratings(files.ratings_by_position(spark, csv), table)
    return spark.read.schema(RATINGS).parquet(table)


def rating_file_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings through a CSV that is read by column name, in another order and among others."""
    csv = fresh_dir(spark, "rating-file")
    ratings = derived.ratings(spark, sf_dir).withColumn("note", F.lit('said "yes", twice'))
    ratings.select("note", "rating", "user_id", "book_id").write.option("header", True).option("escape", '"').csv(csv)
    return files.rating_file(spark, csv)


def book_file_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose titles hold quotes, commas and line breaks, through a CSV."""
    csv = fresh_dir(spark, "book-file")
    quoted = F.concat(F.lit('The "'), F.col("title"), F.lit('", by '), F.col("author"))
    broken = F.concat(F.col("title"), F.lit("\nVolume "), F.col("author"))
    books = derived.books(spark, sf_dir).select(
        F.when(F.col("ext_book_id") % 3 == 0, quoted).when(F.col("ext_book_id") % 3 == 1, broken).otherwise(F.col("title")).alias("title"),
        "author",
        F.col("ext_book_id").alias("id"),
    )
    books.write.option("header", True).option("escape", '"').csv(csv)
    return files.book_file(spark, csv, line_breaks=True)


def lookup_file_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``lookup_load``, where the order of the rows is that of a file."""
    csv, order = fresh_dir(spark, "lookup-file"), ["l_orderkey", "l_linenumber", "l_suppkey"]
    rows = derived.table(spark, sf_dir, "lineitem").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(
        F.col("l_partkey").alias("r_index"),
        derived.ext_book_id("l_partkey").alias("book_id"),
        derived.isbn10("l_suppkey").alias("isbn"),
    ).write.option("header", True).csv(csv)
    return tables.new_lookup_rows(files.lookup_file(spark, csv), _economy_lookup(spark, sf_dir), ["position"])


def ratings_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rating table through a CSV with empty and broken cells: rows that are right, and the text of
    those that are not."""
    csv = fresh_dir(spark, "rating-cells")
    row, text = F.col("col_id"), lambda name: F.col(name).cast("string")
    cells = _rating_table(spark, sf_dir).select(
        "col_id",
        F.when(row % 11 != 0, text("user_id")).alias("user_id"),
        F.when(row % 13 == 0, "x").otherwise(text("rating")).alias("rating"),
        "book_id", "username", "isbn10",
    )
    cells.write.option("header", True).csv(csv)
    good, bad = files.ratings_with_quarantine(spark, csv)
    rejects = bad.select(F.col(files.CORRUPT).alias("reject"))
    return good.unionByName(rejects, allowMissingColumns=True)


def lookup_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup rows with many repeats per id; the first of each is added if it is new."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey"]
    incoming = derived.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("int").alias("gr_id"),
        derived.ext_book_id("l_partkey").alias("ext_book_id"),
        derived.isbn10("l_suppkey").alias("isbn10"),
        *order,
    )
    return tables.new_lookup_rows(incoming, _economy_lookup(spark, sf_dir), order)


def profile_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.profile_view(derived.ratings(spark, sf_dir), _catalog(spark, sf_dir))


def lookup_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.lookup_misses(derived.ratings(spark, sf_dir), _economy_lookup(spark, sf_dir))


def book_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.search(derived.books(spark, sf_dir), "RING")


def book_search_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.search(derived.books(spark, sf_dir), "widget", "brand#1")


def book_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.details(derived.books(spark, sf_dir), derived.DEFAULT_COVER)


def book_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book, by its external id."""
    one = derived.books(spark, sf_dir).filter(F.col("ext_book_id") == 100294)
    return serve.details(one, derived.DEFAULT_COVER)


def book_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.books(spark, sf_dir).select(
        "ext_book_id",
        lookup_url("https://books.example/search?q=", "title").alias("url"),
        byline("author").alias("byline"),
    )


def xml_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = derived.gr_books(spark, sf_dir).select("ext_book_id", "isbn10")
    books = derived.books(spark, sf_dir).join(lookup, "ext_book_id")
    payloads = books.select(xmlbooks.book_payload().alias("payload"))
    return xmlbooks.parse_books(payloads).drop("description")


def xml_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.floor((F.col("ext_book_id") - 100000) / 7 / PAGE).cast("int")
    return xmlbooks.parse_searches(
        xmlbooks.search_payloads(derived.books(spark, sf_dir), page)
    )


# Keys and ingest


def alloc_user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.allocate_user_ids(_events(spark, sf_dir), _directory(spark, sf_dir))


def alloc_book_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.allocate_book_ids(_events(spark, sf_dir), _economy_lookup(spark, sf_dir))


def dense_user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.dense_ids(derived.users(spark, sf_dir), "username", "dense_id")


def user_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user table after everybody in the incoming ratings has signed up."""
    users = derived.users(spark, sf_dir)
    return users.unionByName(upsert.add_users(users, _events(spark, sf_dir)))


def ingest_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.ingest(
        _events(spark, sf_dir),
        _directory(spark, sf_dir),
        _economy_lookup(spark, sf_dir),
        # Row ids count from 1 without gaps: as many as there are pairs.
        derived.ratings_raw(spark, sf_dir).select("user_id", "book_id").distinct().count() + 1,
    ).ratings


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming ratings out of range, had they not been clamped."""
    events = derived.table(spark, sf_dir, "events")
    unclamped = derived.new_ratings(events).drop("rating", "ts").join(
        events.select(
            F.col("event_id").alias("arrival"),
            F.floor(F.col("value") / 20).cast("int").alias("rating"),
        ),
        "arrival",
    )
    return quality.screen(unclamped, ["username", "ext_book_id"])[1]


# Recommendations from fixed factors


def fixed_factor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_recs(spark, sf_dir)


def fixed_factor_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.with_known_rating(
        _fixed_recs(spark, sf_dir), derived.ratings(spark, sf_dir)
    )


def fixed_factor_unseen_left_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.drop_seen_by_null(
        _fixed_recs(spark, sf_dir), derived.ratings(spark, sf_dir)
    )


def fixed_factor_unseen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.drop_seen(_fixed_recs(spark, sf_dir), derived.ratings(spark, sf_dir))


def fixed_factor_unseen_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed_recs(spark, sf_dir, seen=derived.ratings(spark, sf_dir))


def flatten_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.flatten(recommend.nest(_fixed_recs(spark, sf_dir)))


def recs_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.recs_view(
        _fixed_recs(spark, sf_dir), derived.ratings(spark, sf_dir), _catalog(spark, sf_dir)
    )


def segment_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view for the users of one market segment."""
    customers = derived.table(spark, sf_dir, "customer")
    segment = customers.filter(F.col("c_mktsegment") == "BUILDING")
    users = segment.select(F.col("c_custkey").cast("int").alias("user_id"))
    return serve.recs_view(
        _fixed_recs(spark, sf_dir, users=users.withColumnRenamed("user_id", "id")),
        derived.ratings(spark, sf_dir),
        _catalog(spark, sf_dir),
        users,
    )


def new_user_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in the upper half of the id range, as if they had come after the seed data."""
    ids = derived.factors(spark, sf_dir).select("id")
    cutoff = ids.agg(F.max("id")).first()[0] // 2
    newer = ids.filter(F.col("id") > cutoff)
    return recommend.newer_users(_fixed_recs(spark, sf_dir, users=newer), cutoff)


def one_user_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = derived.factors(spark, sf_dir).filter(F.col("id") == 42).select("id")
    return serve.recs_of_user(_fixed_recs(spark, sf_dir, users=user), 42)


# Splits and trained models


def _sizes(parts: list[DataFrame]) -> DataFrame:
    counts = [
        part.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        for name, part in zip(("training", "validation", "test"), parts)
    ]
    return counts[0].union(counts[1]).union(counts[2])


def _key_split(ratings: DataFrame) -> list[DataFrame]:
    key = F.col("user_id").cast("long") * 31 + F.col("book_id").cast("long") * 17
    return split.by_key(ratings, F.pmod(key, F.lit(10)), 10)


def key_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(_key_split(derived.ratings(spark, sf_dir)))


def hash_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(split.by_hash(derived.ratings(spark, sf_dir), seed=7))


def random_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(split.at_random(derived.ratings(spark, sf_dir), seed=7))


def als_recs_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend_job(derived.ratings(spark, sf_dir), JobConfig(als=SERVED_ALS))


def als_unseen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations per user, and how many of them the user had rated already."""
    recs = als_recs_unseen(spark, sf_dir)
    known = recommend.with_known_rating(recs, derived.ratings(spark, sf_dir))
    return known.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recs"), F.count("rating").alias("rated")
    )


def als_recs_filter_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = JobConfig(als=SERVED_ALS, unseen="filter_after", fit_on="train")
    return recommend_job(derived.ratings(spark, sf_dir), config)


def als_holdout_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = cut(derived.ratings(spark, sf_dir))
    training, _, test = split.by_hash(ratings, seed=7)
    return stats.rmse(model.score(model.fit(training, SERVED_ALS.for_ratings(ratings.count())), test))


def als_holdout_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ratings of the default split's test part the model could score."""
    return als_holdout_rmse(spark, sf_dir).select("scored")


def als_filter_after_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all users, recommendations that were rated before, and users with more than ten."""
    recs = als_recs_filter_after(spark, sf_dir)
    known = recommend.with_known_rating(recs, derived.ratings(spark, sf_dir))
    users = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("recs"), F.count("rating").alias("rated"))
    return users.agg(
        F.coalesce(F.sum("rated"), F.lit(0)).alias("rated"), F.count_if(F.col("recs") > 10).alias("over_limit")
    )


def als_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = cut(derived.ratings(spark, sf_dir))
    training, validation, _ = split.by_hash(ratings, seed=7)
    return model.grid_metrics(training, validation, SERVED_ALS.for_ratings(ratings.count()), parallelism=2)


def als_grid_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many validation ratings each grid point could score, for a split that SQL can do."""
    ratings = cut(derived.ratings(spark, sf_dir))
    training, validation, _ = _key_split(ratings)
    metrics = model.grid_metrics(training, validation, SERVED_ALS.for_ratings(ratings.count()), parallelism=2)
    return metrics.select("grid_pos", "rank", "reg", "scored")


def als_best_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.best_point(als_grid(spark, sf_dir))


def als_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid is searched, and its best point recommends."""
    config = JobConfig(als=SERVED_ALS, tune=True, parallelism=2)
    return recommend_job(derived.ratings(spark, sf_dir), config)


def als_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations for the users who have rated most kinds of books."""
    ratings = cut(derived.ratings(spark, sf_dir))
    fitted = model.fit(ratings, SERVED_ALS.for_ratings(ratings.count()))
    return recommend.top_n_for(fitted, quality.active_users(ratings, 30))


# Streaming


def _run_stream(
    spark: SparkSession, sf_dir: str, job: JobConfig | None, deliveries: int = 1, copies: int = 1, kind=Refresh
) -> Refresh:
    """Deliver the events in parts, in order, each as files of one landing folder, and absorb each part by
    a run of the stream that goes on where the last one ended; return the state, with the folder of the versions."""
    path = fresh_dir(spark, "refresh")
    landing = f"{path}/landing"
    table = derived.table(spark, sf_dir, "events")
    first, last = table.agg(F.coalesce(F.min("event_id"), F.lit(0)), F.coalesce(F.max("event_id"), F.lit(0))).first()
    part = F.floor((F.col("event_id") - first) * deliveries / (last - first + 1))
    sent = table.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy")
    refresh = kind(
        ratings=cut(_rating_table(spark, sf_dir)),
        gr_books=_economy_lookup(spark, sf_dir),
        directory=_directory(spark, sf_dir),
        path=path,
        job=job,
    )
    for each in range(deliveries):
        sent.filter(part == each).write.mode("append").parquet(landing)
        stream = derived.new_ratings(read_rating_files(spark, landing, table.schema))
        if copies > 1:
            stream = without_redelivery(stream, "arrival", "1 day")
        start(stream, refresh, f"{path}/checkpoint").awaitTermination()
    return refresh


def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings a stream of events adds in three deliveries, a batch each."""
    path = _run_stream(spark, sf_dir, None, deliveries=3).path
    return tables.read_versions_before(spark, f"{path}/ratings", 1 << 62, RATINGS)


def stream_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every event is delivered twice."""
    path = _run_stream(spark, sf_dir, None, copies=2).path
    return tables.read_versions_before(spark, f"{path}/ratings", 1 << 62, RATINGS)


def stream_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommendations after the stream has been absorbed."""
    path = _run_stream(spark, sf_dir, JobConfig(als=SERVED_ALS)).path
    return tables.read_version(spark, f"{path}/new_recs")


def stream_rec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations per user after the stream, and how many of them the user had rated by then."""
    path = _run_stream(spark, sf_dir, JobConfig(als=SERVED_ALS)).path
    return _counts_after(spark, sf_dir, path, tables.read_version(spark, f"{path}/new_recs"))


def _counts_after(spark: SparkSession, sf_dir: str, path: str, recs: DataFrame) -> DataFrame:
    added = tables.read_versions_before(spark, f"{path}/ratings", 1 << 62, RATINGS)
    pairs = quality.union_ratings(derived.ratings(spark, sf_dir), added.select("user_id", "book_id", "rating"))
    pairs = pairs.groupBy("user_id", "book_id").agg(F.max("rating").alias("rating"))
    known = recommend.with_known_rating(recs, pairs)
    return known.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recs"), F.count("rating").alias("rated")
    )


def _folded_in(spark: SparkSession, sf_dir: str) -> FoldInRefresh:
    """Three deliveries: a fit with the first, and only who was touched after the second and third."""
    return _run_stream(spark, sf_dir, JobConfig(als=SERVED_ALS), deliveries=3, kind=FoldInRefresh)


def stream_foldin_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded_in(spark, sf_dir).recs(spark)


def stream_foldin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations per user after folding in, and how many of them the user had rated by then."""
    state = _folded_in(spark, sf_dir)
    return _counts_after(spark, sf_dir, state.path, state.recs(spark))


def foldin_half_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folding all users in against a model's book factors is the last half step of its fit: how many users there are,
    and how many of them come out otherwise than the fit left them."""
    ratings = cut(derived.ratings(spark, sf_dir))
    fitted = model.fit(ratings, SERVED_ALS.for_ratings(ratings.count()))
    folded = fold_in(ratings, fitted.itemFactors, SERVED_ALS.reg).select("id", F.col("features").alias("folded"))
    both = fitted.userFactors.join(folded, "id", "full")
    off = F.exists(F.zip_with("features", "folded", lambda a, b: F.abs(a - b)), lambda d: d > 1e-4)
    return both.agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.coalesce(off, F.lit(True))).alias("differing")
    )


QUERIES = {
    run.__name__: run
    for run in (
        rating_counts,
        rating_describe,
        price_describe,
        rating_histogram,
        rating_sparsity,
        rating_mode,
        top_rated_books,
        active_users,
        rmse_fixed,
        dedupe_ratings,
        union_ratings,
        ratings_load,
        rating_file_load,
        book_file_load,
        lookup_file_load,
        ratings_quarantine,
        lookup_load,
        profile_view,
        lookup_misses,
        book_search,
        book_search_author,
        book_detail,
        book_by_id,
        book_links,
        xml_books,
        xml_search,
        alloc_user_ids,
        alloc_book_ids,
        dense_user_ids,
        user_directory,
        ingest_ratings,
        ingest_rejects,
        fixed_factor_topk,
        fixed_factor_known,
        fixed_factor_unseen_left_null,
        fixed_factor_unseen_anti,
        fixed_factor_unseen_exact,
        flatten_recs,
        recs_serving,
        segment_recs,
        new_user_recs,
        one_user_recs,
        key_split_sizes,
        hash_split_sizes,
        random_split_sizes,
        als_recs_unseen,
        als_unseen_counts,
        als_recs_filter_after,
        als_holdout_rmse,
        als_holdout_scored,
        als_filter_after_counts,
        als_grid,
        als_grid_scored,
        als_best_point,
        als_tuned,
        als_subset,
        stream_refresh,
        stream_redelivered,
        stream_recs,
        stream_rec_counts,
        stream_foldin_recs,
        stream_foldin_counts,
        foldin_half_step,
    )
}
