"""Schemas: the page table, the shredded document and the unified row."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# One element of a page.  Elements lie in document order, so the descendants
# of an element are the `size` array entries that follow it, and its text is
# the `tn` entries of the page's text array that start at `t0`.
NODE = T.StructType(
    [
        T.StructField("pre", T.IntegerType()),  # own position in the array
        T.StructField("parent", T.IntegerType()),  # parent's position, -1: none kept
        T.StructField("size", T.IntegerType()),  # number of descendants
        T.StructField("t0", T.IntegerType()),
        T.StructField("tn", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("href", T.StringType()),  # as written; NULL: no attribute
        T.StructField("link", T.StringType()),  # href of an `a`, resolved
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("next_row", T.IntegerType()),  # of a `tr`: next sibling `tr`
    ]
)

# One row of a table of a page: its named cells, the table counted from 0.
TABLE_ROW = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),  # why a page has no elements
        T.StructField("tables", T.ArrayType(TABLE_ROW)),  # NULL: not asked for
    ]
)

# What one family of extractors yields per item, before it is exploded.
ITEM = T.StructType(
    [
        T.StructField("family_rank", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("posted", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("age", T.StringType()),
        T.StructField("table_index", T.IntegerType()),
        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Columns that order rows the way one sequential run would have met them.
# `pos` numbers the rows of a page, family after family.
ORDER = ["page_ord", "pos"]



def order_of(columns: list[str]) -> list[str]:
    """The columns that order a table's rows: `ORDER`, prompts first, pages told apart."""
    return [c for c in ("prompt_id", "page_ord", "page_id", "pos") if c in columns]


# The named value columns of a row, i.e. without order and cell columns.
FIELDS = [f.name for f in ITEM if f.name not in ("family_rank", "cells")]

FAMILIES = {
    "quotes": 1,
    "books": 2,
    "jobs": 3,
    "products": 4,
    "news": 5,
    "metadata": 6,
    "headings": 7,
    "tables": 8,
    "paragraphs": 9,
    "links": 10,
    "lists": 11,
}
