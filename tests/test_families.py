"""Extractors on hand-written pages: the edge cases of each pattern."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators.extract import extract, extract_all, extract_errors, family_sizes
from leafmill.schema import FIELDS


@pytest.fixture(scope="module")
def rows(pages):
    """Rows of one page as dicts without absent fields, in order."""

    def run(html, *families):
        found = extract(pages(html), families or None).orderBy("pos").collect()
        return [
            {k: v for k, v in r.asDict().items() if v is not None and k in (*FIELDS, "cells")}
            for r in found
        ]

    return run


def picks(rows, *names):
    return [tuple(r.get(n) for n in names) for r in rows]


def test_paragraphs_by_length(rows):
    found = rows(f"<p>{'a' * 30}</p><p>{'b' * 31}<p> {'c' * 2001}</p><p></p>", "paragraphs")
    assert picks(found, "text", "href") == [("b" * 31, ""), ("c" * 2000, "")]
    assert found[0]["source"] == "site.example:80"


def test_headings_by_level(rows):
    found = rows("<h2>two</h2><h1>on</h1><h1>one</h1><h6>six</h6><h7>seven</h7>", "headings")
    assert picks(found, "type", "text") == [
        ("heading_h1", "one"), ("heading_h2", "two"), ("heading_h6", "six"),
    ]


def test_title_and_meta(rows):
    found = rows(
        "<title></title><title>b</title><meta NAME='Description' content=' x '>"
        "<meta name=keywords content='  '><meta name=author content=''><meta name=author>"
        "<meta property=og:title content=no><meta name=description content=y>",
        "metadata",
    )
    assert picks(found, "type", "text") == [
        ("page_title", ""), ("meta_description", "x"), ("meta_keywords", ""),
        ("meta_description", "y"),
    ]
    assert rows("<p>no title", "metadata") == []


def test_links(rows):
    found = rows(
        "<a href=/x>abc</a><a href=x>ab</a><a>abcd</a><a href=''>empty</a><a href=/x> abc </a>"
        "<a href='tel:1'>tel</a><a href='#f'>frag</a><a href='HTTP://h'>upper</a>"
        "<a href='mailto:a'>mail</a><a href=/y>abc</a><a href='//[x'>bad</a>",
        "links",
    )
    assert picks(found, "text", "href") == [
        ("abc", "https://site.example:80/x"), ("empty", ""), ("tel", "tel:1"),
        ("frag", "https://site.example:80/d/p?q#f"), ("upper", "HTTP://h"), ("mail", "mailto:a"),
        ("abc", "https://site.example:80/y"),
    ]


def test_link_errors(pages):
    found = extract_errors(pages("<a href='//[x'>bad</a><a href='http://[x'>kept</a>"))
    assert [r["href"] for r in found.collect()] == ["//[x"]


def test_lists(rows):
    found = rows(
        "<div class='main-nav'><ul><li>hidden by its parent</ul></div>"
        "<nav><ul><li>kept, a tag is no class</ul></nav>"
        "<div class='Side SideBar'><p><ul><li>hidden by its parent</ul></div>"
        "<ul><li>0123456789<li>01234567890<li>outer item <a>no</a><a href=q>l</a>"
        "<ul class=menu><li>inner item text</ul></li><div><li>not a child of it</li></div></ul>",
        "lists",
    )
    assert picks(found, "text", "href") == [
        ("kept, a tag is no class", ""), ("01234567890", ""),
        ("outer item nolinner item text", ""), ("inner item text", ""),
    ]


def test_tables(rows):
    found = rows(
        "<table><tr><th>A</th><th>B</th><th>A</th></tr>"
        "<tr><td>1</td><td><a href=x>2</a><a href=y>3</a></td><td>4</td><td>5</td></tr>"
        "<tr></tr><tr><td><a>6</a><a href=z>7</a></td></tr></table>",
        "tables",
    )
    assert [r["cells"] for r in found] == [
        {"A": "A", "B": "B"},
        {"A": "4", "B": "23", "B_link": "x", "col_3": "5"},
        {"A": "67"},
    ]
    assert list(found[1]["cells"]) == ["A", "B", "B_link", "col_3"]
    assert picks(found, "type", "table_index", "text", "href") == [("table_row", 0, None, None)] * 3


def test_table_headers_that_replace_fields(rows):
    found = rows(
        "<table><tr><th>source<th>type<th>text<th>href<th>table_index<th>x_link"
        "<tr><td>S<td>T<td>X<td>H<td>9<td></table>",
        "tables",
    )
    assert picks(found, "source", "type", "text", "href", "table_index")[1] == ("S", "T", "X", "H", 0)
    assert found[1]["cells"]["table_index"] == "9"
    assert found[1]["cells"]["x_link"] == ""


def test_nested_tables_count_twice_and_row_headers_name_cells(rows):
    found = rows(
        "<table><tr><th>h</th><td>a<table><tr><td>b</td></tr></table></td></tr></table>", "tables"
    )
    assert [(r["table_index"], r["cells"]) for r in found] == [
        (0, {"h": "h", "col_1": "ab", "col_2": "b"}),
        (0, {"h": "b"}),
        (1, {"col_0": "b"}),
    ]


def test_only_ten_tables(rows):
    found = rows("<table><tr><td>x</table>" * 11, "tables")
    assert [r["table_index"] for r in found] == list(range(10))


def test_quotes(rows):
    found = rows(
        "<div class='x quote'><span class=text>A</span><small class=author>B</small>"
        "<a class=tag>c <b> d</b></a><a class='tag x'>e</a></div>"
        "<div class=quote><span class=text>F</span></div>"
        "<div class=quote><span class=texts>G</span></div><p class=quote><span class=text>H",
        "quotes",
    )
    assert picks(found, "type", "text", "author", "tags", "href") == [
        ("quote", "A", "B", "cd, e", ""), ("quote", "F", "", "", ""),
    ]


def test_books(rows):
    found = rows(
        "<article class=product_pod><p class='star-rating Two Three'></p><h3><a title=T href=u>A</a></h3>"
        "<p class=price_color>1</p></article>"
        "<article class=product_pod><h3>B</h3><p class='star-rating'></p></article>"
        "<article class=product_pod><h3>C</h3><p class='my-star-rating'></p></article>"
        "<article class=product_pod><p class=price_color>2</p></article>",
        "books",
    )
    assert picks(found, "text", "price", "rating", "href") == [
        ("A", "1", "Three", "u"), ("B", "", "", ""), ("C", "", "my-star-rating", ""),
    ]


def test_jobs(rows):
    found = rows(
        "<div class=card-content><h2 class=title>A</h2><h3 class=company>B</h3>"
        "<p class=location> C </p><time>D</time><time>E</time></div>"
        "<div class=card-content><h2 class=title></h2></div>"
        "<div class=card-content><h2>no class</h2></div>",
        "jobs",
    )
    assert picks(found, "text", "company", "location", "posted", "href") == [
        ("A", "B", "C", "D", ""), ("", "", "", "", ""),
    ]


def test_products(rows):
    star = "<span class='a ws-icon-star'></span>"
    found = rows(
        f"<div class=thumbnail><h4>0</h4><h4 class=price>1</h4><a class=title href=u>A</a>"
        f"<p class=description>B</p><div class=ratings><p>{star * 3}</p></div>{star}</div>"
        "<div class=thumbnail><h4>2</h4><a class=title>C</a></div><div class=thumbnail><h4>3</h4></div>",
        "products",
    )
    assert picks(found, "text", "price", "description", "rating", "href") == [
        ("A", "1", "B", "3", "u"), ("C", "2", "", "0", ""),
    ]


def test_news(rows):
    story = "<tr class=athing><td><span class=titleline><a href=u>{}</a> <a>site</a></span></td></tr>"
    found = rows(
        "<table>" + story.format("A") + " <!-- x --> <tr class=any><td><span class=score>1 point</span>"
        "<span class=age>now</span></td></tr>" + story.format("B")
        + "<tr class=athing><td><span class=titleline>C</span></td></tr>"
        "<tr class=athing><td>no title</td></tr></table>",
        "news",
    )
    assert picks(found, "text", "href", "score", "age") == [
        ("A", "u", "1 point", "now"), ("B", "u", "", ""), ("", "", "", ""),
    ]


def test_all_families_keep_their_order(pages, rows):
    html = (
        "<title>title</title><h1>head</h1><p>" + "p" * 40 + "<a href=l>link</a></p>"
        "<ul><li>a list item</ul><table><tr><td>cell</table>"
        "<div class=quote><span class=text>quote</span></div>"
    )
    types = [r["type"] for r in rows(html)]
    assert types == [
        "quote", "page_title", "heading_h1", "table_row", "paragraph", "link", "list_item",
    ]
    assert extract_all(pages(html)).agg(F.max("pos"), F.count("*")).first() == (6, 7)
    sizes = family_sizes(pages(html, "")).orderBy("page_id").collect()
    assert sizes[0]["links"] == 1 and sizes[1]["links"] == 0


def test_source_names(pages):
    two = pages("<h1>one</h1>", "<h1>two</h1>")
    named = two.withColumn("source_name", F.when(F.col("page_id") == 0, "").otherwise("Mine"))
    found = extract(named, ["headings"]).orderBy("page_id").collect()
    assert [r["source"] for r in found] == ["site.example:80", "Mine"]


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_partitions_do_not_matter(spark, parts):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = extract_all(pages.repartition(parts)).drop("cells")
    expected = extract_all(pages).drop("cells")
    assert rows.exceptAll(expected).isEmpty() and expected.exceptAll(rows).isEmpty()
