import pytest
from pyspark.sql import functions as F

from conftest import rows
from tomewise import schemas
from tomewise.sources import files, jdbc, tables, xmlbooks

HEADER = "col_id,user_id,rating,book_id,username,isbn10\n"


def written(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_rating_and_book_files_by_name(spark, tmp_path):
    path = written(tmp_path, "ratings.csv", "book_id,user_id,rating\n1,7,4\n2,7,5\n")
    assert rows(files.rating_file(spark, path)) == [(1, 7, 4.0), (2, 7, 5.0)]
    path = written(tmp_path, "books.csv", 'best_id,title,id\n9,"Night, Day",3\n')
    assert rows(files.book_file(spark, path)) == [(3, "Night, Day")]


def test_lookup_keeps_leading_zeros_and_file_order(spark, tmp_path):
    text = "r_index,book_id,isbn\n1,100,0012345678\n2,200,x\n1,300,later\n"
    df = files.lookup_file(spark, written(tmp_path, "lookup.csv", text))
    existing = spark.createDataFrame([(2, 5, "y")], schemas.GR_BOOKS)
    new = tables.new_lookup_rows(df, existing, ["position"])
    assert rows(new) == [(1, 100, "0012345678")]


def test_lookup_order_goes_over_files_without_their_paths(spark, tmp_path):
    """The first file by name wins, also below a folder whose name is escaped in paths; rows are sorted by numbers only."""
    folder = tmp_path / "look up+é%20"
    folder.mkdir()
    for name, text in (("b.csv", "1,300,later\n3,9,b\n"), ("a.csv", "1,100,first\n2,200,x\n1,5,second\n"), ("c.csv", "3,8,c\n")):
        written(folder, name, "r_index,book_id,isbn\n" + text)
    df = files.lookup_file(spark, str(folder))
    new = tables.new_lookup_rows(df, spark.createDataFrame([], schemas.GR_BOOKS), ["position"])
    assert rows(new) == [(1, 100, "first"), (2, 200, "x"), (3, 9, "b")]
    assert "string" not in dict(df.dtypes)["position"]


BAD = HEADER + "1,2,3,4,ann,0\n2,2,three,4,ann,0\n"


def test_bad_row_fails_the_whole_load(spark, tmp_path):
    incoming = files.ratings_by_position(spark, written(tmp_path, "bad.csv", BAD))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        tables.append_ratings(incoming, str(tmp_path / "table"))
    assert not list((tmp_path / "table").glob("*.parquet"))


def test_bad_row_can_be_quarantined(spark, tmp_path):
    good, bad = files.ratings_with_quarantine(spark, written(tmp_path, "bad.csv", BAD))
    assert rows(good) == [(1, 2, 3.0, 4, "ann", "0")]
    assert [r[files.CORRUPT] for r in bad.collect()] == ["2,2,three,4,ann,0"]
    assert good.select("user_id").count() == bad.select("user_id").count() == 1


def test_ratings_load_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    one = schemas.rows(spark, [(1, 1, 3.0, 1, "a", "x"), (2, 1, 4.0, 2, "a", "y")], schemas.RATINGS)
    tables.append_ratings(one, path)
    existing = spark.read.parquet(path)
    with pytest.raises(tables.DuplicateKey):
        tables.append_ratings(one.filter("col_id = 2"), path, existing)
    with pytest.raises(tables.DuplicateKey):
        tables.append_ratings(one.withColumn("col_id", F.lit(9)), path, existing)
    assert spark.read.parquet(path).count() == 2


def test_versions_are_replaced_and_read_in_order(spark, tmp_path):
    base = str(tmp_path / "t")
    for version, value in ((0, 1), (10, 3), (2, 2), (2, 5)):
        tables.write_version(spark.createDataFrame([(value,)], "v INT"), base, version)
    (tmp_path / "t" / "version=11").mkdir()
    assert tables.versions(spark, base) == [0, 2, 10]
    assert rows(tables.read_version(spark, base)) == [(3,)]
    schema = tables.read_version(spark, base).schema
    assert rows(tables.read_versions_before(spark, base, 10, schema)) == [(1,), (5,)]
    assert tables.read_versions_before(spark, base, 0, schema).count() == 0
    assert tables.versions(spark, str(tmp_path / "absent")) == []


def test_tables_views_and_preview(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shop LOCATION '{tmp_path}/shop'")
    spark.catalog.setCurrentDatabase("shop")
    try:
        schemas.ensure_tables(spark)
        schemas.ensure_tables(spark)
        assert {t.name for t in spark.catalog.listTables()} >= set(schemas.TABLES)
        assert spark.table("new_recs").schema == schemas.NEW_RECS
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE shop CASCADE")
    tables.register_view(spark.range(5), "five")
    assert tables.preview(spark.table("five"), 2).count() == 2


def test_declared_types_are_enforced(spark):
    wide = spark.createDataFrame([(2**31, 1, 1.0)], "user_id BIGINT, book_id INT, prediction DOUBLE")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        schemas.conform(wide, schemas.NEW_RECS).collect()


BOOK = """<book><id>5</id><isbn>0012345678</isbn><title>A &amp; B</title>
<authors><author><name>Ann</name></author></authors>
<publication_year>1999</publication_year><description>d</description></book>"""
WORK = """<work><best_book type="Book"><id type="integer">{}</id><title>T</title>{}</best_book></work>"""


def test_book_xml(spark, tmp_path):
    expected = [(5, "0012345678", "A & B", "Ann", 1999, None, "d")]
    payloads = spark.createDataFrame([(BOOK,)], "payload STRING")
    assert rows(xmlbooks.parse_books(payloads)) == expected
    path = written(tmp_path, "books.xml", f"<books>{BOOK}</books>")
    assert rows(xmlbooks.read_books(spark, path)) == expected


def test_search_xml_with_attributes_and_gaps(spark, tmp_path):
    works = WORK.format(1, "<author><name>Ann</name></author><image_url>p</image_url>") + WORK.format(2, "")
    text = f"<response><search><results>{works}</results></search></response>"
    expected = [(1, "T", "Ann", "p"), (2, "T", None, None)]
    payloads = spark.createDataFrame([(text,)], "payload STRING")
    assert rows(xmlbooks.parse_searches(payloads)) == expected
    assert rows(xmlbooks.read_works(spark, written(tmp_path, "found.xml", text))) == expected


def test_payloads_survive_a_round_trip(spark):
    books = spark.createDataFrame(
        [(1, "i", "a < b & c > d", None, None, None), (2, None, "t", "Ann", 1990, "u")],
        "ext_book_id INT, isbn10 STRING, title STRING, author STRING, publication_year INT,"
        " image_url STRING",
    )
    parsed = xmlbooks.parse_books(books.select(xmlbooks.book_payload().alias("payload")))
    assert rows(parsed.drop("description")) == rows(books)
    found = xmlbooks.parse_searches(xmlbooks.search_payloads(books, F.lit(1)))
    assert rows(found) == rows(books.select("ext_book_id", "title", "author", "image_url"))


class Recorder:
    """Stands in for the reader of a session whose database is out of reach."""

    def __init__(self, bounds):
        self.read, self.bounds, self.calls = self, bounds, []

    def jdbc(self, url, table, **options):
        self.calls.append((url, table, options))
        return self

    def first(self):
        return self.bounds

    def isEmpty(self):
        return self.bounds["hi"] is None


def test_jdbc_reads_in_parallel_over_the_key_range():
    source = jdbc.JdbcTable("jdbc:x", "ratings", {"user": "u"})
    recorder = Recorder({"lo": 1, "hi": 90})
    jdbc.read_table(recorder, source, "col_id", 4)
    _, table, options = recorder.calls[1]
    assert table == "ratings"
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == (1, 91, 4)
    recorder = Recorder({"lo": None, "hi": None})
    jdbc.read_table(recorder, source, "col_id", 4)
    assert "numPartitions" not in recorder.calls[1][2]
    # Rows, but none with a value to split on: one read of everything is refused.
    with pytest.raises(ValueError):
        jdbc.read_table(Recorder({"lo": None, "hi": 90}), source, "col_id", 4)


def test_payloads_whose_shape_drifts(spark):
    from tomewise.sources.xmlbooks import parse_drifting_books, payload_shape

    book = "<book><id>{}</id><isbn>001</isbn><title>007</title>{}</book>"
    payloads = [
        (1, book.format(1, "<authors><author><name>A</name></author></authors>"), "A"),
        (2, "<response>" + book.format(2, "<authors><author><name>A</name></author><author><name>B</name></author></authors>") + "</response>", "A, B"),
        (3, book.format(3, "<authors><author>A</author><author>B</author></authors>").replace("<id>", '<id type="integer">'), "A, B"),
        (4, book.format(4, "<authors><author>A</author></authors>"), "A"),
        (5, book.format(5, "<authors>A, B</authors>"), "A, B"),
        (6, book.format(6, ""), None),
        (7, book.format(7, "<authors/>"), None),
        (8, book.format(8, "<authors><author><name>A</name><id>9</id></author></authors>"), "A"),
    ]
    df = spark.createDataFrame([(p,) for _, p, _ in payloads], "payload STRING")
    got = sorted((r.ext_book_id, r.author, r.isbn10, r.title) for r in parse_drifting_books(df).collect())
    assert got == [(i, names, "001", "007") for i, _, names in payloads]
    shape = payload_shape(df).first()
    assert shape.payloads == 8 and "id: VARIANT" in shape["shape"] and "author: VARIANT" in shape["shape"]
    with pytest.raises(Exception, match="no id"):
        parse_drifting_books(spark.createDataFrame([("<book><title>x</title></book>",)], "payload STRING")).collect()
