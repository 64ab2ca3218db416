"""Counts, column lists and samples of extracted rows, all before deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import display_trunc
from leafmill.operators.extract import family_sizes
from leafmill.schema import FAMILIES, order_of

SUMMARY_SAMPLE = 5
API_SAMPLE = 10

# The fields a row of each family has, in order.
FAMILY_FIELDS = {
    "quotes": ["source", "type", "text", "author", "tags", "href"],
    "books": ["source", "type", "text", "price", "rating", "href"],
    "jobs": ["source", "type", "text", "company", "location", "posted", "href"],
    "products": ["source", "type", "text", "price", "description", "rating", "href"],
    "news": ["source", "type", "text", "score", "age", "href"],
    "tables": ["source", "type", "table_index"],
}
_HEADERS = "_leafmill_headers"
_PLAIN_FIELDS = ["source", "type", "text", "href"]


def row_fields(headers: Column) -> Column:
    """The names of the fields a row has, in the order they were set; ``headers``: those of its cells."""
    names = None
    for family, fields in FAMILY_FIELDS.items():
        hit = F.col("family_rank") == FAMILIES[family]
        value = _names(fields)
        if family == "tables":
            value = F.array_distinct(F.concat(value, headers))
        names = F.when(hit, value) if names is None else names.when(hit, value)
    return names.otherwise(_names(_PLAIN_FIELDS))


def _names(fields: Sequence[str]) -> Column:
    return F.array(*[F.lit(f) for f in fields])


def row_shapes(rows: DataFrame, *more: Column) -> DataFrame:
    """The field lists of the rows, by their headers: how often, where first met, and ``more`` aggregates.

    One pass with partial aggregation; what leaves it is as large as the number
    of different table headings, not of rows, and only there the names are put
    together.  The place is one number so that the aggregation stays a hash
    aggregation.
    """
    page = F.col("page_ord").cast("decimal(20,0)")
    place = page * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    headers = F.when(F.col("family_rank") == FAMILIES["tables"], F.map_keys("cells"))
    shapes = rows.groupBy("family_rank", headers.alias(_HEADERS)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(place).alias("first_place"), *more
    )
    return shapes.withColumn(_HEADERS, row_fields(F.col(_HEADERS))).withColumnRenamed(_HEADERS, "fields")


def column_order(rows: DataFrame) -> DataFrame:
    """The columns a wide table of the rows has, with the place each is first met."""
    return shape_columns(row_shapes(rows))


def shape_columns(shapes: DataFrame) -> DataFrame:
    """`column_order` of rows with these shapes."""
    named = shapes.select("first_place", F.posexplode("fields").alias("at", "name"))
    return named.groupBy("name").agg(F.min(F.struct("first_place", "at")).alias("first_met"))


def summary_totals(rows: DataFrame) -> DataFrame:
    """Number of rows and of different columns."""
    named = row_shapes(rows).select("n_rows", F.posexplode("fields").alias("at", "name"))
    return named.agg(
        F.coalesce(F.sum(F.when(F.col("at") == 0, F.col("n_rows"))), F.lit(0)).alias("total_rows"),
        F.count_distinct("name").alias("total_columns"),
    )


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"))


def summary_by_source(rows: DataFrame) -> DataFrame:
    """Rows per source, largest first."""
    return _counts(rows, "source").orderBy(F.desc("n_rows"), "source")


def summary_by_type(rows: DataFrame) -> DataFrame:
    """Rows per type, largest first."""
    return _counts(rows, "type").orderBy(F.desc("n_rows"), "type")


def page_counts(pages: DataFrame) -> DataFrame:
    """Rows per page, in all and by family group; pages without rows count 0."""
    sizes = family_sizes(pages)
    structured = sum((F.col(f) for f in ("books", "jobs", "products", "news")), F.col("quotes"))
    total = sum((F.col(f) for f in FAMILIES), F.lit(0))
    return sizes.select(
        "page_id",
        structured.cast("bigint").alias("structured"),
        *[
            F.col(f).cast("bigint").alias(f)
            for f in ("metadata", "headings", "tables", "paragraphs", "links", "lists")
        ],
        total.cast("bigint").alias("total_rows"),
    )


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first rows in run order: a top-n, not a sort of the table."""
    return rows.orderBy(*order_of(rows.columns)).limit(n)


def summary_sample(rows: DataFrame) -> DataFrame:
    """The first five rows as the summary shows them; absent text reads `nan`."""
    return first_rows(rows, SUMMARY_SAMPLE).select(
        display_trunc(F.col("source"), 20, "nan").alias("source"),
        display_trunc(F.col("type"), 15, "nan").alias("type"),
        display_trunc(F.col("text"), 80, "nan").alias("text"),
    )


def cli_sample(rows: DataFrame) -> DataFrame:
    """The first five rows with texts of up to 100 characters."""
    return first_rows(rows, SUMMARY_SAMPLE).select(
        F.coalesce("source", F.lit("?")).alias("source"),
        F.coalesce("type", F.lit("?")).alias("type"),
        display_trunc(F.col("text"), 100).alias("text"),
    )


def cli_more(rows: DataFrame) -> DataFrame:
    """How many rows follow the shown ones."""
    return rows.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - SUMMARY_SAMPLE).alias("more_rows"))


def api_sample(rows: DataFrame) -> DataFrame:
    """The first ten whole rows."""
    return first_rows(rows, API_SAMPLE)
