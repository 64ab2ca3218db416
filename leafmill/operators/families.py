"""The extractors: each maps a document column to an array of `schema.ITEM`.

Every extractor looks at one page only, so all of them run where the page is
read; nothing is shuffled before the rows are deduplicated or counted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.bind import bound
from leafmill.functions.text import has_skip_class, join_tags
from leafmill.operators import dom
from leafmill.operators.dom import find_all, first, is_tag, or_empty, subtree
from leafmill.schema import FAMILIES, ITEM

MIN_LIST_TEXT = 10
MIN_PARAGRAPH_TEXT = 30
MIN_HEADING_TEXT = 2
MIN_LINK_TEXT = 2
META_NAMES = ["description", "keywords", "author"]


@lru_cache(maxsize=1)
def _absent(application: str) -> dict[str, Column]:
    """A NULL of the right type for every field of ITEM."""
    return {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in ITEM}


def _item(family: str, **values: Column) -> Column:
    """One ITEM; fields that are not named stay NULL."""
    values["family_rank"] = F.lit(FAMILIES[family])
    fields = _absent(SparkSession.active().sparkContext.applicationId)
    return F.struct(*[values[k].alias(k) if k in values else fields[k] for k in fields])


def _longer(items: Column, length: int) -> Column:
    return F.filter(items, lambda item: F.length(item["text"]) > length)


def title(doc: Column, source: Column) -> Column:
    node = first(doc["nodes"], is_tag("title"))
    found = F.filter(F.array(node), lambda n: n.isNotNull())
    return F.transform(
        found,
        lambda n: _item(
            "metadata", source=source, type=F.lit("page_title"),
            text=dom.text(doc, n), href=F.lit(""),
        ),
    )


def meta(doc: Column, source: Column) -> Column:
    def wanted(node: Column) -> Column:
        known = F.lower(node["name"]).isin(*META_NAMES)
        return (node["tag"] == "meta") & known & (node["content"] != "")

    return F.transform(
        find_all(doc["nodes"], wanted),
        lambda n: _item(
            "metadata", source=source,
            type=F.concat(F.lit("meta_"), F.lower(n["name"])),
            text=dom.clean_text(n["content"]), href=F.lit(""),
        ),
    )


def metadata(doc: Column, source: Column) -> Column:
    return F.concat(title(doc, source), meta(doc, source))


def headings(doc: Column, source: Column) -> Column:
    """All h1, then all h2, ... up to h6."""
    levels = find_all(doc["nodes"], is_tag(*[f"h{level}" for level in range(1, 7)]))
    ordered = F.sort_array(F.transform(levels, lambda n: F.struct(n["tag"], n["pre"], n.alias("n"))))
    items = F.transform(
        ordered,
        lambda x: _item(
            "headings", source=source, type=F.concat(F.lit("heading_"), x["tag"]),
            text=dom.text(doc, x["n"]), href=F.lit(""),
        ),
    )
    return _longer(items, MIN_HEADING_TEXT)


def paragraphs(doc: Column, source: Column) -> Column:
    items = F.transform(
        find_all(doc["nodes"], is_tag("p")),
        lambda n: _item(
            "paragraphs", source=source, type=F.lit("paragraph"),
            text=dom.text(doc, n), href=F.lit(""),
        ),
    )
    return _longer(items, MIN_PARAGRAPH_TEXT)


def _anchors(doc: Column) -> Column:
    return find_all(doc["nodes"], lambda n: (n["tag"] == "a") & n["href"].isNotNull())


def _ends(sorted_: Column) -> Column:
    """Of sorted structs the first of each run with one ``key``."""

    def ends(item: Column, i: Column) -> Column:
        return (i == 0) | (item["key"] != F.get(sorted_, i - 1)["key"])

    return F.filter(sorted_, ends)


def links(doc: Column, source: Column) -> Column:
    """Links with their address resolved; the first of equal (text, href) stays."""
    found = F.transform(
        F.filter(_anchors(doc), lambda n: n["link"].isNotNull()),
        lambda n: F.struct(
            n["pre"].alias("pre"), dom.text(doc, n).alias("text"), n["link"].alias("href")
        ),
    )
    keyed = F.transform(
        _longer(found, MIN_LINK_TEXT),
        lambda x: F.struct(F.concat(x["text"], F.lit("|"), x["href"]).alias("key"), x["pre"].alias("pre"), x.alias("x")),
    )
    first = F.transform(bound(F.sort_array(keyed), lambda s: _ends(s)), lambda k: k["x"])
    return F.transform(
        F.sort_array(first),
        lambda x: _item(
            "links", source=source, type=F.lit("link"), text=x["text"], href=x["href"]
        ),
    )


def bad_links(doc: Column) -> Column:
    """The hrefs of a page that cannot be resolved against its address."""
    broken = F.filter(_anchors(doc), lambda n: n["link"].isNull())
    return F.transform(broken, lambda n: n["href"])


def lists(doc: Column, source: Column) -> Column:
    """Direct items of lists, except lists right inside a navigation class."""

    def wanted(node: Column) -> Column:
        holder = dom.parent(doc, node)
        skip = has_skip_class(dom.parent(doc, holder)["classes"])
        return (node["tag"] == "li") & holder["tag"].isin("ul", "ol") & ~skip

    ordered = F.sort_array(
        F.transform(
            find_all(doc["nodes"], wanted), lambda n: F.struct(n["parent"], n["pre"], n.alias("n"))
        )
    )
    items = F.transform(
        ordered,
        lambda x: _item(
            "lists", source=source, type=F.lit("list_item"), text=dom.text(doc, x["n"]),
            href=or_empty(first(subtree(doc, x["n"]), is_tag("a"))["href"]),
        ),
    )
    return _longer(items, MIN_LIST_TEXT)


def tables(doc: Column, source: Column) -> Column:
    """The rows of the first tables, whose cells are named by their headers (see `shred`).

    Fields that headers are called like are filled in by `with_replaced`, once the rows
    stand alone: there it is compiled code, inside a lambda it is not.
    """
    return F.transform(doc["tables"], lambda row: table_row(row, source))


def table_row(row: Column, source: Column) -> Column:
    """The item of one row of a table."""
    return _item("tables", source=source, type=F.lit("table_row"), table_index=row["index"], cells=row["cells"])


_REPLACED = "_replaced"


def with_replaced(rows: DataFrame) -> DataFrame:
    """Rows with the fields of table rows replaced by the cells whose header is called like them."""
    fields = [f.name for f in ITEM if f.dataType.simpleString() == "string"]
    named = F.arrays_overlap(F.map_keys("cells"), F.array(*[F.lit(n) for n in fields]))
    is_table = F.col("family_rank") == FAMILIES["tables"]
    marked = rows.withColumn(_REPLACED, is_table & named)

    def field(name: str) -> Column:
        if name not in fields:
            return F.col(name)
        cell = F.try_element_at("cells", F.lit(name))
        return F.when(F.col(_REPLACED), F.coalesce(cell, F.col(name))).otherwise(F.col(name)).alias(name)

    return marked.select(*[field(name) for name in rows.columns])


def _records(doc: Column, container: Column, parts: Callable[[Column], dict[str, Column]]) -> Column:
    """The named parts of each container, found once and kept beside it."""
    with_descendants = F.transform(
        container, lambda n: F.struct(n.alias("node"), subtree(doc, n).alias("sub"))
    )
    return F.transform(
        with_descendants,
        lambda c: F.struct(
            c["node"].alias("node"), *[value.alias(k) for k, value in parts(c).items()]
        ),
    )


def quotes(doc: Column, source: Column) -> Column:
    records = _records(
        doc,
        find_all(doc["nodes"], is_tag("div", cls="quote")),
        lambda c: {
            "body": first(c["sub"], is_tag("span", cls="text")),
            "author": first(c["sub"], is_tag("small", cls="author")),
            "tags": find_all(c["sub"], is_tag("a", cls="tag")),
        },
    )
    return F.transform(
        F.filter(records, lambda r: r["body"].isNotNull()),
        lambda r: _item(
            "quotes", source=source, type=F.lit("quote"),
            text=dom.text(doc, r["body"]), author=dom.text(doc, r["author"]),
            tags=join_tags(F.transform(r["tags"], lambda n: dom.stripped_text(doc, n))),
            href=F.lit(""),
        ),
    )


def books(doc: Column, source: Column) -> Column:
    records = _records(
        doc,
        find_all(doc["nodes"], is_tag("article", cls="product_pod")),
        lambda c: {
            "title": first(c["sub"], is_tag("h3")),
            "price": first(c["sub"], is_tag("p", cls="price_color")),
            "rating": first(
                c["sub"], lambda n: (n["tag"] == "p") & dom.class_contains(n, "star-rating")
            ),
            "link": first(c["sub"], is_tag("a")),
        },
    )

    def stars(node: Column) -> Column:
        tokens = F.filter(node["classes"], lambda token: token != "star-rating")
        return or_empty(F.try_element_at(tokens, F.lit(-1)))

    return F.transform(
        F.filter(records, lambda r: r["title"].isNotNull()),
        lambda r: _item(
            "books", source=source, type=F.lit("book"),
            text=dom.text(doc, r["title"]), price=dom.text(doc, r["price"]),
            rating=stars(r["rating"]), href=or_empty(r["link"]["href"]),
        ),
    )


def jobs(doc: Column, source: Column) -> Column:
    records = _records(
        doc,
        find_all(doc["nodes"], is_tag("div", cls="card-content")),
        lambda c: {
            "title": first(c["sub"], is_tag("h2", cls="title")),
            "company": first(c["sub"], is_tag("h3", cls="company")),
            "location": first(c["sub"], is_tag("p", cls="location")),
            "posted": first(c["sub"], is_tag("time")),
        },
    )
    return F.transform(
        F.filter(records, lambda r: r["title"].isNotNull()),
        lambda r: _item(
            "jobs", source=source, type=F.lit("job"),
            text=dom.text(doc, r["title"]), company=dom.text(doc, r["company"]),
            location=dom.text(doc, r["location"]), posted=dom.text(doc, r["posted"]),
            href=F.lit(""),
        ),
    )


def products(doc: Column, source: Column) -> Column:
    records = _records(
        doc,
        find_all(doc["nodes"], is_tag("div", cls="thumbnail")),
        lambda c: {
            "title": first(c["sub"], is_tag("a", cls="title")),
            "price": F.coalesce(
                first(c["sub"], is_tag("h4", cls="price")), first(c["sub"], is_tag("h4"))
            ),
            "description": first(c["sub"], is_tag("p", cls="description")),
            "ratings": first(c["sub"], is_tag("div", cls="ratings")),
        },
    )

    def stars(node: Column) -> Column:
        found = find_all(subtree(doc, node), is_tag("span", cls="ws-icon-star"))
        # Without a box of ratings the size is NULL or -1, as the session's mode has it.
        return F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0)).cast("string")

    return F.transform(
        F.filter(records, lambda r: r["title"].isNotNull()),
        lambda r: _item(
            "products", source=source, type=F.lit("product"),
            text=dom.text(doc, r["title"]), price=dom.text(doc, r["price"]),
            description=dom.text(doc, r["description"]), rating=stars(r["ratings"]),
            href=or_empty(r["title"]["href"]),
        ),
    )


def news(doc: Column, source: Column) -> Column:
    def parts(c: Column) -> dict[str, Column]:
        below = subtree(doc, dom.next_row(doc, c["node"]))
        return {
            "title": first(c["sub"], is_tag("span", cls="titleline")),
            "score": first(below, is_tag("span", cls="score")),
            "age": first(below, is_tag("span", cls="age")),
        }

    records = _records(doc, find_all(doc["nodes"], is_tag("tr", cls="athing")), parts)
    titled = F.transform(
        F.filter(records, lambda r: r["title"].isNotNull()),
        lambda r: F.struct(
            r["node"].alias("node"), r["score"].alias("score"), r["age"].alias("age"),
            first(subtree(doc, r["title"]), is_tag("a")).alias("link"),
        ),
    )
    return F.transform(
        titled,
        lambda r: _item(
            "news", source=source, type=F.lit("news_story"),
            text=dom.text(doc, r["link"]), href=or_empty(r["link"]["href"]),
            score=dom.text(doc, r["score"]), age=dom.text(doc, r["age"]),
        ),
    )


# The elements without one of which a family has no rows.
NEEDED = {
    "quotes": ["div"], "books": ["article"], "jobs": ["div"], "products": ["div"], "news": ["tr"],
    "metadata": ["title", "meta"], "headings": [f"h{level}" for level in range(1, 7)], "paragraphs": ["p"],
    "links": ["a"], "lists": ["li"],
}

EXTRACTORS: dict[str, Callable[[Column, Column], Column]] = {
    "quotes": quotes,
    "books": books,
    "jobs": jobs,
    "products": products,
    "news": news,
    "metadata": metadata,
    "headings": headings,
    "tables": tables,
    "paragraphs": paragraphs,
    "links": links,
    "lists": lists,
}
