"""Questions to a shredded document, as expressions over its arrays.

Elements lie in document order, so a subtree is a slice: no join and no
shuffle is needed to ask for descendants, and the cost of a question is the
number of elements it looks at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import SPACE, clean_text

Test = Callable[[Column], Column]


def is_tag(*tags: str, cls: str | None = None) -> Test:
    """An element of one of the tags and, if given, with the class token."""

    def test(node: Column) -> Column:
        fits = node["tag"] == tags[0] if len(tags) == 1 else node["tag"].isin(*tags)
        return fits if cls is None else fits & has_class(node, cls)

    return test


def has_class(node: Column, token: str) -> Column:
    return F.coalesce(F.array_contains(node["classes"], token), F.lit(False))


def class_contains(node: Column, part: str) -> Column:
    """Whether any class token contains `part`."""
    found = F.exists(node["classes"], lambda token: F.contains(token, F.lit(part)))
    return F.coalesce(found, F.lit(False))


def find_all(nodes: Column, test: Test) -> Column:
    return F.filter(nodes, test)


def first(nodes: Column, test: Test) -> Column:
    """The first element that passes, NULL when there is none."""
    return F.get(F.filter(nodes, test), F.lit(0))


def subtree(doc: Column, node: Column) -> Column:
    """All descendants of an element, in document order."""
    return F.slice(doc["nodes"], node["pre"] + 2, node["size"])


def children(doc: Column, node: Column) -> Column:
    return F.filter(subtree(doc, node), lambda child: child["parent"] == node["pre"])


def at(doc: Column, position: Column) -> Column:
    """The element at a position; NULL for an unknown (NULL, negative) one."""
    return F.get(doc["nodes"], position)


def parent(doc: Column, node: Column) -> Column:
    return at(doc, node["parent"])


def next_row(doc: Column, node: Column) -> Column:
    """The next sibling `tr` of a `tr`."""
    return at(doc, node["next_row"])


def strings(doc: Column, node: Column) -> Column:
    return F.slice(doc["texts"], node["t0"] + 1, node["tn"])


def raw_text(doc: Column, node: Column) -> Column:
    """The text of a subtree as written; NULL for a NULL element.  Most elements hold one string."""
    return F.when(node["tn"] == 1, F.get(doc["texts"], node["t0"])).otherwise(F.array_join(strings(doc, node), ""))


def text(doc: Column, node: Column) -> Column:
    """The cleaned text of a subtree, '' for a NULL element."""
    return clean_text(raw_text(doc, node))


def stripped_text(doc: Column, node: Column) -> Column:
    """Each string of a subtree trimmed, then joined without a separator."""
    return F.array_join(F.transform(strings(doc, node), _strip), "")


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))
