"""Rows that were once lost, doubled or let in."""

import pytest

from tests.conftest import rows
from tomewise.operators.topk import best_items
from tomewise.operators.upsert import ingest
from tomewise.schemas import GR_BOOKS, NEW_RATINGS, RATINGS
from tomewise.sources import files, tables, xmlbooks

HEADER = "col_id,user_id,rating,book_id,username,isbn10\n"


def test_quotes_and_line_breaks_in_csv(spark, tmp_path):
    path = tmp_path / "books.csv"
    path.write_text('id,title\n1,"plain, with comma"\n2,"A ""B"", C"\n3,"two\nlines"\n')
    got = rows(files.book_file(spark, str(path), line_breaks=True))
    assert got == [(1, "plain, with comma"), (2, 'A "B", C'), (3, "two\nlines")]


def test_empty_numbers_are_set_aside(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text(HEADER + "1,2,3,4,ann,0\n2,,3,4,ann,0\n3,2,x,4,ann,0\n")
    good, bad = files.ratings_with_quarantine(spark, str(path))
    assert [r.col_id for r in good.collect()] == [1]
    assert sorted(r._corrupt for r in bad.collect()) == ["2,,3.0,4,ann,0", "3,2,x,4,ann,0"]


def test_a_missing_number_is_not_appended(spark, tmp_path):
    incoming = spark.createDataFrame([(1, None, 3.0, 4, "ann", "0")], RATINGS)
    with pytest.raises(tables.MissingNumber, match="user_id"):
        tables.append_ratings(incoming, str(tmp_path / "r"))


def test_repeated_lookup_keys_do_not_repeat_ratings(spark):
    batch = spark.createDataFrame([(1, "ann", 70, "x", 5)], NEW_RATINGS)
    directory = spark.createDataFrame([(8, "ann"), (3, "ann")], "user_id INT, username STRING")
    books = spark.createDataFrame([(6, 70, "x"), (2, 70, "y")], GR_BOOKS)
    got = ingest(batch, directory, books, 1).ratings
    assert [(r.user_id, r.book_id) for r in got.collect()] == [(3, 2)]


def test_wrapped_book_and_several_authors(spark):
    book = (
        "<book><id>7</id><title>T</title><authors><author><name>A</name></author>"
        "<author><name>B</name></author></authors></book>"
    )
    payloads = spark.createDataFrame([(book,), (f"<response>{book}</response>",)], "payload STRING")
    got = xmlbooks.parse_books(payloads).select("ext_book_id", "title", "author").collect()
    assert [tuple(r) for r in got] == [(7, "T", "A, B")] * 2
    nameless = spark.createDataFrame([("<response><x>1</x></response>",)], "payload STRING")
    with pytest.raises(Exception, match="no id"):
        xmlbooks.parse_books(nameless).collect()


def test_the_newest_version_of_nothing_is_named(spark, tmp_path):
    with pytest.raises(LookupError, match="no version"):
        tables.read_version(spark, str(tmp_path / "none"))


def test_copies_of_items_do_not_follow_the_cores(spark):
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "id INT, features ARRAY<FLOAT>")
    plan = best_items(few, few, 3)._jdf.queryExecution().logical().toString()
    assert "sequence(0, 0" in plan
