"""Pages in, typed rows out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.urls import netloc
from leafmill.operators.families import EXTRACTORS, NEEDED, bad_links, table_row, with_replaced
from leafmill.operators.shred import shred
from leafmill.schema import ITEM
from leafmill.session import prepare

DOC = "_doc"
_TAGS = "_tags"
_KEYS = ["page_id", "url", "page_ord", "source"]


@lru_cache(maxsize=64)
def _rows_of(family: str, application: str) -> Column:
    """The expression of one family; building it is slow, so it is kept."""
    return EXTRACTORS[family](F.col(DOC), F.col("source"))


def _where_needed(family: str, rows: Column) -> Column:
    if family not in NEEDED:
        return rows
    there = F.arrays_overlap(F.col(_TAGS), F.array(*[F.lit(tag) for tag in NEEDED[family]]))
    return F.when(there, rows).otherwise(F.array().cast(T.ArrayType(ITEM)))


def default_source(url: Column, source_name: Column | None = None) -> Column:
    """The given name of a source; its host when there is none or it is empty."""
    host = netloc(url)
    if source_name is None:
        return host
    return F.coalesce(F.when(source_name != "", source_name), host)


def with_document(
    pages: DataFrame, keep_all: bool = False, partitions: int | None = None, links: bool = True,
    tables: bool = False, nodes: bool = True,
) -> DataFrame:
    """Add the shredded document of each page; without markup it has no elements.

    ``page_ord`` defaults to ``page_id`` and ``source`` to the host.  Columns
    other than the keys are dropped before pages cross into the worker.  Pages
    are shredded where they are read; ``partitions`` deals them out anew first,
    for files that Spark cannot split into enough tasks.  Without ``links`` no
    address is resolved; the rows of tables are made only with ``tables``, and
    without ``nodes`` nothing else is.
    """
    prepare(pages.sparkSession)
    if "page_ord" not in pages.columns:
        pages = pages.withColumn("page_ord", F.col("page_id"))
    name = F.col("source_name") if "source_name" in pages.columns else None
    pages = pages.withColumn("source", default_source(F.col("url"), name))
    pages = pages.select(*_KEYS, "html")
    if partitions is not None:
        pages = pages.repartition(partitions)
    return pages.select(*_KEYS, shred("html", "url", keep_all, links, tables, nodes).alias(DOC))


def extract(
    pages: DataFrame, families: Iterable[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """The rows of the named families (default: all) of every page.

    One scan and one pass over the markup serve all families, and no shuffle:
    each page yields its rows where it was read, unless ``partitions`` says
    otherwise (see `with_document`).
    """
    names = list(EXTRACTORS if families is None else families)
    documents = with_document(
        pages, partitions=partitions, links="links" in names, tables="tables" in names,
        nodes=set(names) != {"tables"},
    )
    application = pages.sparkSession.sparkContext.applicationId
    keys = [k for k in _KEYS if k != "source"]
    if names == ["tables"]:
        # Nothing is made inside a lambda: the rows are there.  The outer form keeps Spark from
        # testing the size of the array first, for which it would shred every page a second time.
        found = documents.select(*_KEYS, F.posexplode_outer(F.col(DOC)["tables"]).alias("pos", "row"))
        rows = found.filter(F.col("pos").isNotNull()).select(*keys, "pos", table_row(F.col("row"), F.col("source")).alias("item"))
    else:
        # A family is asked only where a page has an element that its rows begin at.
        documents = documents.withColumn(_TAGS, F.transform(F.col(DOC)["nodes"], lambda n: n["tag"]))
        items = [_where_needed(name, _rows_of(name, application)) for name in names]
        both = F.flatten(F.array(*items)) if len(items) > 1 else items[0]
        rows = documents.select(*keys, F.posexplode(both).alias("pos", "item"))
    rows = rows.select(*keys, "pos", "item.*")
    return with_replaced(rows) if "tables" in names else rows


def extract_all(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """All families of all pages, ordered by ``schema.ORDER``."""
    return extract(pages, partitions=partitions)


def family_sizes(pages: DataFrame) -> DataFrame:
    """How many rows of each family a page has, without making the rows."""
    documents = with_document(pages, tables=True)
    application = pages.sparkSession.sparkContext.applicationId
    sizes = [F.size(_rows_of(name, application)).alias(name) for name in EXTRACTORS]
    return documents.select("page_id", "url", *sizes)


def extract_errors(pages: DataFrame) -> DataFrame:
    """What could not be read, one row each, with the reason: links, and whole pages (without an href)."""
    return document_errors(with_document(pages))


def document_errors(documents: DataFrame) -> DataFrame:
    """`extract_errors` of shredded pages."""
    doc, absent = F.col(DOC), F.lit(None).cast("string")

    def entry(href: Column, reason: Column) -> Column:
        return F.struct(href.alias("href"), reason.alias("reason"))

    links = F.transform(bad_links(doc), lambda href: entry(href, F.lit("malformed link address")))
    page = F.filter(F.array(entry(absent, doc["error"])), lambda e: e["reason"].isNotNull())
    errors = documents.select("page_id", "url", F.explode(F.concat(links, page)).alias("e"))
    return errors.select("page_id", "url", "e.href", "e.reason")
