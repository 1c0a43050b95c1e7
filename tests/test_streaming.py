from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tomewise.operators.upsert import ingest
from tomewise.plans.model import AlsConfig
from tomewise.plans.recommend_job import JobConfig
from tomewise.schemas import GR_BOOKS, RATINGS, struct, INT, TEXT
from tomewise.session import shared_dir
from tomewise.sources import tables
from tomewise.streaming.refresh import ForeignCheckpoint, Refresh, read_rating_files, start, without_redelivery

BATCH = "arrival BIGINT, username STRING, ext_book_id INT, isbn10 STRING, rating INT, ts TIMESTAMP"


def events(spark, arrivals):
    return spark.createDataFrame([(a,) for a in arrivals], "arrival BIGINT").select(
        "arrival",
        F.concat(F.lit("u"), (F.col("arrival") % 4).cast("string")).alias("username"),
        (F.lit(100) + F.col("arrival") % 5).cast("int").alias("ext_book_id"),
        F.lit("i").alias("isbn10"),
        (F.lit(1) + F.col("arrival") % 5).cast("int").alias("rating"),
        F.timestamp_seconds(F.col("arrival")).alias("ts"),
    )


def refresh(spark, path, job=None):
    return Refresh(
        ratings=spark.createDataFrame([(1, 1, 4.0, 1, "u1", "i")], RATINGS),
        gr_books=spark.createDataFrame([(1, 101, "i")], GR_BOOKS),
        directory=spark.createDataFrame([(1, "u1")], struct(user_id=INT, username=TEXT)),
        path=path,
        job=job,
    )


def drop_file(df, folder, name):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, tmp_path, job=None):
    stream = read_rating_files(
        spark, f"{tmp_path}/in/*", events(spark, [0]).schema, max_files=1
    )
    start(
        stream, refresh(spark, f"{tmp_path}/out", job), f"{tmp_path}/checkpoint"
    ).awaitTermination()


def absorbed(spark, tmp_path):
    return tables.read_versions_before(spark, f"{tmp_path}/out/ratings", 1 << 30, RATINGS)


def test_restart_absorbs_only_new_files_and_ids_continue(spark, tmp_path):
    drop_file(events(spark, range(0, 10)), tmp_path / "in", "a")
    run(spark, tmp_path)
    drop_file(events(spark, range(10, 20)), tmp_path / "in", "b")
    run(spark, tmp_path)
    got = absorbed(spark, tmp_path)
    assert sorted(r.col_id for r in got.collect()) == list(range(2, 22))
    per_name = got.groupBy("username").agg(F.countDistinct("user_id").alias("ids"))
    assert {r.ids for r in per_name.collect()} == {1}
    seeded = ingest(
        events(spark, range(20)),
        spark.createDataFrame([(1, "u1")], "user_id INT, username STRING"),
        spark.createDataFrame([(1, 101, "i")], GR_BOOKS),
        2,
    )
    assert rows(got) == rows(seeded.ratings)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    state = refresh(spark, f"{tmp_path}/out")
    state(events(spark, range(8)), 0)
    state(events(spark, range(8, 12)), 1)
    before = rows(absorbed(spark, tmp_path))
    state(events(spark, range(8, 12)), 1)
    assert rows(absorbed(spark, tmp_path)) == before
    assert len(before) == 12
    state(events(spark, []), 2)
    assert rows(absorbed(spark, tmp_path)) == before


def test_recommendations_follow_each_batch(spark, tmp_path):
    job = JobConfig(als=AlsConfig(seed=1, rank=2, max_iter=2), n=2)
    state = refresh(spark, f"{tmp_path}/out", job)
    state(events(spark, range(0, 12)), 0)
    state(events(spark, range(12, 16)), 1)
    recs = tables.read_version(spark, f"{tmp_path}/out/new_recs")
    assert recs.columns == ["user_id", "book_id", "prediction"]
    everything = absorbed(spark, tmp_path).unionByName(state.ratings)
    assert recs.join(everything, ["user_id", "book_id"]).count() == 0
    state(events(spark, []), 2)
    assert tables.versions(spark, f"{tmp_path}/out/new_recs") == [0, 1]


def test_redelivered_ratings_are_dropped(spark, tmp_path):
    drop_file(events(spark, [1, 2, 2, 3]), tmp_path / "in", "a")
    stream = read_rating_files(spark, f"{tmp_path}/in/*", events(spark, [0]).schema)
    once = without_redelivery(stream, "arrival", "10 minutes")
    start(once, refresh(spark, f"{tmp_path}/out"), f"{tmp_path}/checkpoint").awaitTermination()
    assert absorbed(spark, tmp_path).count() == 3


def test_another_checkpoint_is_refused(spark, tmp_path):
    drop_file(events(spark, range(0, 5)), tmp_path / "in", "a")
    run(spark, tmp_path)
    before = rows(absorbed(spark, tmp_path))
    stream = read_rating_files(spark, f"{tmp_path}/in/*", events(spark, [0]).schema)
    state = refresh(spark, f"{tmp_path}/out")
    with pytest.raises(ForeignCheckpoint):
        start(stream, state, f"{tmp_path}/other")
    # Versions that no checkpoint knows of.
    unbound = refresh(spark, f"{tmp_path}/unbound")
    unbound(events(spark, range(3)), 0)
    with pytest.raises(ForeignCheckpoint):
        start(stream, unbound, f"{tmp_path}/other")
    assert rows(absorbed(spark, tmp_path)) == before


def test_ten_batches_leave_no_folders_and_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tomewise.streaming.refresh.MERGE_AT", 4)
    state = refresh(spark, f"{tmp_path}/out")
    state(events(spark, range(0, 2)), 0)
    assert tables.versions(spark, f"{tmp_path}/out/ratings") == [0]
    kept = len(list(Path(shared_dir(spark).removeprefix("file:")).iterdir()))
    for n in range(1, 10):
        state(events(spark, range(2 * n, 2 * n + 2)), n)
    assert len(list(Path(shared_dir(spark).removeprefix("file:")).iterdir())) == kept
    assert sorted(r.col_id for r in absorbed(spark, tmp_path).collect()) == list(range(2, 22))
    folders = {p.name for p in (tmp_path / "out" / "ratings").iterdir()}
    assert folders == {"upto=3", "upto=7", "version=8", "version=9"}
    assert tables.last_version(spark, f"{tmp_path}/out/ratings") == 9
    before = rows(absorbed(spark, tmp_path))
    state(events(spark, range(18, 20)), 9)
    assert rows(absorbed(spark, tmp_path)) == before
    with pytest.raises(LookupError):
        tables.read_versions_before(spark, f"{tmp_path}/out/ratings", 5, RATINGS)
