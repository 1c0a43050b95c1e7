from conftest import rows
from tomewise.operators import recommend, serve, split
from tomewise.functions.book_columns import byline, cover, lookup_url
from tomewise.plans import derived
from tomewise.plans.model import AlsConfig, fit

RECS = "user_id INT, book_id INT, prediction DOUBLE"


def recs(spark):
    return spark.createDataFrame([(1, 1, 4.0), (1, 2, 3.5), (2, 1, 2.0)], RECS)


def seen(spark):
    return spark.createDataFrame(
        [(1, 1, 5.0), (1, 1, 4.0), (2, 1, None)], "user_id INT, book_id INT, rating DOUBLE"
    )


def test_unseen_by_anti_join_and_by_null(spark):
    assert rows(recommend.drop_seen(recs(spark), seen(spark))) == [(1, 2, 3.5)]
    # A NULL rating looks unseen to the outer join.
    by_null = recommend.drop_seen_by_null(recs(spark), seen(spark))
    assert rows(by_null) == [(1, 2, 3.5), (2, 1, 2.0)]


def test_nest_and_flatten(spark):
    nested = recommend.nest(recs(spark))
    assert [r.book_id for r in nested.filter("user_id = 1").first().recommendations] == [1, 2]
    assert rows(recommend.flatten(nested)) == rows(recs(spark))


def test_cutoff(spark):
    assert rows(recommend.newer_users(recs(spark), 1)) == [(2, 1, 2.0)]
    assert recommend.newer_users(recs(spark), None).count() == 3


def catalog_parts(spark):
    lookup = spark.createDataFrame([(1, 101, "x")], "gr_id INT, ext_book_id INT, isbn10 STRING")
    books = spark.createDataFrame(
        [(101, "Red Ring", "Ann", 1999, None), (102, "ring of fire", "Bob", 2000, "pic")],
        "ext_book_id INT, title STRING, author STRING, publication_year INT, image_url STRING",
    )
    return lookup, books


def test_profile_keeps_ratings_of_unknown_books(spark):
    lookup, books = catalog_parts(spark)
    catalog = serve.catalog(lookup, books, "none.jpg")
    ratings = spark.createDataFrame([(1, 1, 5.0), (1, 9, 2.0)], "user_id INT, book_id INT, rating DOUBLE")
    assert rows(serve.profile_view(ratings, catalog)) == [
        (1, None, None, None, 2.0),
        (1, 101, "Red Ring", "none.jpg", 5.0),
    ]
    assert rows(serve.lookup_misses(ratings, lookup)) == [(1,)]


def test_recs_view_shows_rated_books_only(spark):
    catalog = serve.catalog(*catalog_parts(spark), "none.jpg")
    ratings = seen(spark)
    got = serve.recs_view(recs(spark), ratings, catalog)
    assert rows(got) == [(1, 101, "Red Ring", "none.jpg", 4.0), (2, 101, "Red Ring", "none.jpg", 2.0)]
    one = spark.createDataFrame([(2,), (2,)], "user_id INT")
    assert serve.recs_view(recs(spark), ratings, catalog, one).count() == 1
    assert serve.recs_of_user(recs(spark), 1).count() == 2


def test_search_and_details(spark):
    _, books = catalog_parts(spark)
    assert [r.title for r in serve.search(books, "RING").collect()] == ["Red Ring", "ring of fire"]
    assert [r.title for r in serve.search(books, "ring", "bob").collect()] == ["ring of fire"]
    detail = serve.details(books, "none.jpg", 101).first()
    assert detail.image_url == "none.jpg" and detail.rateable
    lost = spark.createDataFrame([(None, "t", None, None, "")], books.schema)
    shown = serve.details(lost, "none.jpg").first()
    assert not shown.rateable and shown.image_url == "none.jpg"


def test_book_columns(spark):
    df = spark.createDataFrame([("a b&c", None, "x")], "t STRING, a STRING, i STRING")
    got = df.select(lookup_url("u?q=", "t"), byline("a"), cover("i", "d")).first()
    assert tuple(got) == ("u?q=a+b%26c", None, "x")


def test_hash_split_does_not_depend_on_partitions(spark, sf_dir):
    ratings = derived.ratings(spark, sf_dir)
    first = split.by_hash(ratings, 7)
    again = split.by_hash(ratings.repartition(5), 7)
    for a, b in zip(first, again):
        assert rows(a) == rows(b)
    assert sum(part.count() for part in first) == ratings.count()
    assert rows(split.by_hash(ratings, 8)[0]) != rows(first[0])


def test_top_n_is_that_of_the_model_by_large_blocks(spark, sf_dir):
    ratings = derived.ratings(spark, sf_dir)
    model = fit(ratings, AlsConfig(seed=3, rank=5, max_iter=2))
    some = ratings.select("user_id").filter("user_id % 3 = 0")
    for ours, theirs in (
        (recommend.top_n(model, 4), model.recommendForAllUsers(4)),
        (recommend.top_n_for(model, some.union(some), 4), model.recommendForUserSubset(some.distinct(), 4)),
    ):
        # Equal but for the order of what differs by rounding.
        found = {(r.user_id, r.book_id): r.prediction for r in ours.collect()}
        want = {(r.user_id, r.book_id): r.prediction for r in recommend.flatten(theirs).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-5 for k in want)
        assert "CartesianProduct" not in ours._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroups" in ours._jdf.queryExecution().executedPlan().toString()
