"""Book and search payloads in XML, as a column or as files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of the payloads. Attributes are prefixed with ``_`` and the
# text beside them is ``_VALUE``.
BOOK = (
    "id BIGINT, isbn STRING, title STRING, image_url STRING, description STRING,"
    " authors STRUCT<author: ARRAY<STRUCT<name: STRING>>>, publication_year INT"
)
WORK = (
    "best_book STRUCT<id: STRUCT<_VALUE: BIGINT, _type: STRING>, title: STRING,"
    " author: STRUCT<name: STRING>, image_url: STRING>"
)
SEARCH = f"search STRUCT<results: STRUCT<work: ARRAY<STRUCT<{WORK}>>>>"


_BOOK_FIELDS = ("id", "isbn", "title", "image_url", "description", "authors", "publication_year")


def _book_columns(book: str = "") -> list[Column]:
    at = f"{book}." if book else ""
    no_id = F.raise_error(F.lit("a book payload has no id"))
    return [
        F.coalesce(F.col(f"{at}id").cast("int"), no_id).alias("ext_book_id"),
        F.col(f"{at}isbn").alias("isbn10"),
        F.col(f"{at}title").alias("title"),
        F.nullif(F.array_join(F.col(f"{at}authors.author.name"), ", "), F.lit("")).alias("author"),
        F.col(f"{at}publication_year").alias("publication_year"),
        F.col(f"{at}image_url").alias("image_url"),
        F.col(f"{at}description").alias("description"),
    ]


def _work_columns(work: str) -> list[Column]:
    return [
        F.col(f"{work}.id._VALUE").cast("int").alias("ext_book_id"),
        F.col(f"{work}.title").alias("title"),
        F.col(f"{work}.author.name").alias("author"),
        F.col(f"{work}.image_url").alias("image_url"),
    ]


def parse_books(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One book per payload, which is the book element or holds it one level below its root.

    Several authors are joined in their order. A payload without a book id raises.
    """
    fields = BOOK.replace(" STRING", ": STRING").replace(" BIGINT", ": BIGINT").replace(" INT", ": INT")
    inner = fields.replace("::", ":").replace("authors STRUCT", "authors: STRUCT")
    schema = f"{BOOK}, book STRUCT<{inner}>"
    parsed = payloads.select(F.from_xml(column, schema, {"mode": "FAILFAST"}).alias("root"))
    book = F.coalesce("root.book", F.struct(*[F.col(f"root.{name}") for name in _BOOK_FIELDS]))
    return parsed.select(book.alias("book")).select(*_book_columns("book"))


# The fields that come in several shapes are VARIANT; text stays text, so that an ISBN keeps its zeros.
DRIFTING = (
    "id VARIANT, isbn STRING, title STRING, image_url STRING, description STRING,"
    " authors VARIANT, publication_year INT"
)


def _shape(value: Column) -> Column:
    return F.schema_of_variant(value)


def _drifting_id(value: Column) -> Column:
    """A number, or a number beside attributes."""
    return F.coalesce(F.try_variant_get(value, "$", "int"), F.try_variant_get(value, "$._VALUE", "int"))


def _drifting_authors(value: Column) -> Column:
    """Names, joined in their order: of one author or several, as elements or as plain text."""
    several = F.try_variant_get(value, "$.author", "array<struct<name: string>>")
    named = F.filter(F.transform(several, lambda a: a["name"]), lambda name: name.isNotNull())
    plain = F.when(_shape(value).startswith("OBJECT<author: ARRAY<"), F.try_variant_get(value, "$.author", "array<string>"))
    one = F.when(~_shape(value).startswith("OBJECT<author: OBJECT<"), F.try_variant_get(value, "$.author", "string"))
    text = F.when(_shape(value) == "STRING", F.try_variant_get(value, "$", "string"))
    found = F.coalesce(
        F.when(F.size(named) > 0, F.array_join(named, ", ")),
        F.array_join(plain, ", "),
        F.try_variant_get(value, "$.author.name", "string"),
        one,
        text,
    )
    return F.nullif(found, F.lit(""))


def parse_drifting_books(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """As :func:`parse_books`, of payloads whose shape changes from row to row: the book may be wrapped, its id may have
    attributes, and its authors may be one or several, elements with a name or plain text. A number that stands for a
    name loses its leading zeros. A payload without a book id raises."""
    inner = ", ".join(": ".join(field.split(" ")) for field in DRIFTING.split(", "))
    schema = f"{DRIFTING}, book STRUCT<{inner}>"
    parsed = payloads.select(F.from_xml(column, schema, {"mode": "FAILFAST"}).alias("root"))
    wrapped = lambda name: F.when(F.col("root.book").isNotNull(), F.col(f"root.book.{name}")).otherwise(F.col(f"root.{name}"))
    no_id = F.raise_error(F.lit("a book payload has no id"))
    return parsed.select(
        F.coalesce(_drifting_id(wrapped("id")), no_id.cast("int")).alias("ext_book_id"),
        wrapped("isbn").alias("isbn10"),
        wrapped("title").alias("title"),
        _drifting_authors(wrapped("authors")).alias("author"),
        wrapped("publication_year").alias("publication_year"),
        wrapped("image_url").alias("image_url"),
        wrapped("description").alias("description"),
    )


def payload_shape(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row (payloads, shape): the schema that covers all payloads, with VARIANT where they disagree."""
    parsed = payloads.select(F.from_xml(column, "variant").alias("v"))
    return parsed.agg(F.count("v").alias("payloads"), F.schema_of_variant_agg("v").alias("shape"))


def parse_searches(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per work of every search payload."""
    parsed = payloads.select(F.from_xml(column, SEARCH, {"mode": "FAILFAST"}).alias("found"))
    works = parsed.select(F.explode("found.search.results.work.best_book").alias("work"))
    return works.select(*_work_columns("work"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Files of ``<book>`` elements; Spark splits large ones."""
    return spark.read.schema(BOOK).option("rowTag", "book").xml(path).select(*_book_columns())


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Files of search payloads, one row per ``<work>``."""
    works = spark.read.schema(WORK).option("rowTag", "work").xml(path)
    return works.select(*_work_columns("best_book"))


def _text(column: str) -> Column:
    escaped = F.col(column).cast("string")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return escaped


def _element(name: str, content: Column) -> Column:
    """``<name>content</name>``, or nothing where the content is NULL."""
    filled = F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name}>"))
    return F.coalesce(filled, F.lit(""))


def book_payload(isbn: str = "isbn10") -> Column:
    """The XML of one catalog row: what :func:`parse_books` reads."""
    author = _element("authors", _element("author", _element("name", _text("author"))))
    return F.concat(
        F.lit("<book>"),
        _element("id", _text("ext_book_id")),
        _element("isbn", _text(isbn)),
        _element("title", _text("title")),
        _element("image_url", _text("image_url")),
        author,
        _element("publication_year", _text("publication_year")),
        F.lit("</book>"),
    )


def work_payload() -> Column:
    """The ``<work>`` element of one catalog row."""
    return F.concat(
        F.lit('<work><best_book><id type="integer">'),
        _text("ext_book_id"),
        F.lit("</id>"),
        _element("title", _text("title")),
        _element("author", _element("name", _text("author"))),
        _element("image_url", _text("image_url")),
        F.lit("</best_book></work>"),
    )


def search_payloads(books: DataFrame, page: Column) -> DataFrame:
    """Search payloads of the books of each ``page``; a page has to be of bounded size."""
    return (
        books.select(page.alias("page"), work_payload().alias("work"))
        .groupBy("page")
        .agg(F.array_join(F.collect_list("work"), "").alias("works"))
        .select(
            "page",
            F.concat(
                F.lit("<response><search><results>"),
                F.col("works"),
                F.lit("</results></search></response>"),
            ).alias("payload"),
        )
    )
