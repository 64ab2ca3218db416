"""The shredder: element structure and text, one small page per rule."""

import random
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from leafmill.functions.text import clean_text, python_clean_text
from leafmill.operators import shred as shred_module
from leafmill.operators.extract import document_errors
from leafmill.operators.shred import _Columns, shred
from leafmill.schema import DOCUMENT


def parse(html, base="https://h.example/d/"):
    """[(tag, parent tag, text)] of a page, all elements kept."""
    columns = _Columns(keep_all=True)
    columns.add_page(html, base)
    (nodes,) = (d["nodes"] for d in columns.to_arrow().to_pylist())
    out = []
    for n in nodes:
        holder = nodes[n["parent"]]["tag"] if n["parent"] >= 0 else None
        out.append((n["tag"], holder, "".join(columns.texts[n["t0"] : n["t0"] + n["tn"]])))
    return out


def body(html):
    return [n for n in parse(html) if n[0] not in ("html", "head", "body")]


CASES = {
    "paragraph ends at a block": ("<p>a<div>b</div>", [("p", "body", "a"), ("div", "body", "b")]),
    "bold and paragraph end at a paragraph": (
        "<p><b>a<br>b<p>c",
        [("p", "body", "ab"), ("b", "p", "ab"), ("br", "b", ""), ("p", "body", "c")],
    ),
    "italic does not end at a paragraph": (
        "<p><i>a<p>b",
        [("p", "body", "ab"), ("i", "p", "ab"), ("p", "i", "b")],
    ),
    "newer blocks stay inside a paragraph": (
        "<p>a<section>b",
        [("p", "body", "ab"), ("section", "p", "b")],
    ),
    "list items": (
        "<ul><li>a<li>b<ul><li>c</ul>d</ul>",
        [
            ("ul", "body", "abcd"), ("li", "ul", "a"), ("li", "ul", "bcd"),
            ("ul", "li", "c"), ("li", "ul", "c"),
        ],
    ),
    "table cells": (
        "<table><tr><th>a<td>b<tr><td>c</table>d",
        [
            ("table", "body", "abc"), ("tr", "table", "ab"), ("th", "tr", "a"), ("td", "tr", "b"),
            ("tr", "table", "c"), ("td", "tr", "c"),
        ],
    ),
    "unmatched end tag": ("<div>a</span>b</div>", [("div", "body", "ab")]),
    "end tag closes what is open inside": ("<div><p>a<b>b</div>c", [
        ("div", "body", "ab"), ("p", "div", "ab"), ("b", "p", "b")]),
    "end tag does not reach past a stronger element": (
        "<span><div>a</span>b</div>c</span>",
        [("span", "body", "abc"), ("div", "span", "ab")],
    ),
    "script text": (
        '<p>a<script>var t="</p><p>";</script>b</p>',
        [("p", "body", "ab"), ("script", "p", "")],
    ),
    "comments and declarations": ("<!DOCTYPE x><p>a<!-- <p> -->b<?php c ?></p>", [("p", "body", "ab")]),
    "open comment runs to the end": ("<p>a<!-- <p>b", [("p", "body", "a")]),
    "bare text opens a paragraph": ('{"a": "b"}', [("p", "body", '{"a": "b"}')]),
    "text after a block does not": ("<div>a</div>b", [("div", "body", "a")]),
    "less-than as text": ("<p>1 < 2 <3</p>", [("p", "body", "1 < 2 <3")]),
    "references": ("<p>&lt;p&gt; &amp;amp; &copy &#233; &nope;</p>", [("p", "body", "<p> &amp; © é &nope;")]),
    "quoted angle bracket": ('<p title="a>b">c</p>', [("p", "body", "c")]),
    "upper case": ("<P>a</P>", [("p", "body", "a")]),
    "broken last tag": ("<p>a<a href='x", [("p", "body", "a")]),
    "ruby and template text": (
        "<p>a<rt>b</rt><template>c</template>d</p>",
        [("p", "body", "ad"), ("rt", "p", ""), ("template", "p", "")],
    ),
    "text after the end": ("<body><p>a</p></body></html>b<p>c", [("p", "body", "a"), ("p", "body", "c")]),
    "form in form": ("<form>a<form>b", [("form", "body", "a"), ("form", "body", "b")]),
    "title holds text only": ("<title>a <b>c</title>", [("title", "head", "a <b>c")]),
}


@pytest.mark.parametrize("name", CASES)
def test_structure(name):
    html, expected = CASES[name]
    assert body(html) == expected


def test_implied_elements():
    assert [n[:2] for n in parse("<title>t</title><p>x")] == [
        ("html", None), ("head", "html"), ("title", "head"), ("body", "html"), ("p", "body"),
    ]
    assert [n[0] for n in parse("<html><head></head><body><p></body></html>")] == [
        "html", "head", "body", "p",
    ]


def test_attributes(spark, pages):
    html = (
        "<a class=' x  y ' HREF=one href=two>1</a><a href>2</a><a>3</a>"
        "<a href='?a=1&amp;copy=2&copy=3&lt'>4</a><meta NAME=n content='&quot;c&quot;'>"
    )
    nodes = pages(("https://h.example/d/e?z", html)).select(shred("html", "url").alias("d"))
    found = {n["content"] or str(n["pre"]): n for n in nodes.first()["d"]["nodes"]}
    a = found["0"]
    assert (a["classes"], a["href"], a["link"]) == (["x", "y"], "one", "https://h.example/d/one")
    assert (found["1"]["href"], found["1"]["link"]) == ("", "")
    assert (found["2"]["href"], found["2"]["link"]) == (None, None)
    assert found["3"]["href"] == "?a=1&copy=2&copy=3<"
    assert found['"c"']["name"] == "n"


def test_subtrees_are_slices():
    columns = _Columns(keep_all=False)
    columns.add_page("<div class=a><p>1<div class=b><p>2</div></div><p>3", "")
    (nodes,) = (d["nodes"] for d in columns.to_arrow().to_pylist())
    assert [(n["tag"], n["parent"], n["size"], n["t0"], n["tn"]) for n in nodes] == [
        ("div", -1, 3, 0, 2), ("p", 0, 0, 0, 1), ("div", 0, 1, 1, 1), ("p", 2, 0, 1, 1),
        ("p", -1, 0, 2, 1),
    ]


def test_many_open_elements_take_linear_time():
    columns = _Columns(keep_all=True)
    columns.add_page("<b>" * 20_000 + "x" + "</i>" * 50, "")
    assert columns.text_counts[2] == 1


def test_empty_pages(pages):
    shredded = pages("", None, "<p>x").select("page_id", shred("html", "url").alias("d")).collect()
    assert [len(r["d"]["nodes"]) for r in shredded] == [0, 0, 1]


def test_a_page_that_fails_leaves_the_others(spark, monkeypatch):
    """Its elements go, its reason stays, and it is told among the errors."""
    columns, short = shred_module._Columns(False), shred_module._short_attributes

    def failing(text):
        if "boom" in text:
            raise RecursionError("too deep")
        return short(text)

    monkeypatch.setattr(shred_module, "_short_attributes", failing)
    for html in ("<p>one", "<p>two<a href='boom'>x</a>", "<a href='//[x'>bad</a>", None):
        columns.add_page(html, "https://h/")
    made = columns.to_arrow().to_pylist()
    assert [d["error"] for d in made] == [None, "RecursionError: too deep", None, None]
    assert made[1]["nodes"] == made[1]["texts"] == made[3]["nodes"] == []
    assert made[0]["texts"] == ["one"] and made[2]["texts"] == ["bad"]
    rows = [(i, "https://h/", d) for i, d in enumerate(made)]
    kind = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("_doc", DOCUMENT)])
    errors = document_errors(spark.createDataFrame(rows, kind)).orderBy("page_id").collect()
    assert [tuple(r) for r in errors] == [
        (1, "https://h/", None, "RecursionError: too deep"), (2, "https://h/", "//[x", "malformed link address"),
    ]


TABLES = (
    "<ul class=nav><li>menu</ul><table><tr><th>a<th>a<th>b</tr><tr><td>1 <td> 2  3<td><b>4</b><a href='/x'>5</a>"
    "<ul><li>item</ul></table><table><tr><tr class=athing><td class=c>6<tr><td>7<table><tr><td>8​</table></table>"
)


def test_tables_are_read_where_pages_are_shredded():
    """Rows are made without elements; of a repeated name the last value stays, in the place of the first."""
    columns = _Columns(False, links=False, tables=True, nodes=False)
    for html in (TABLES, None, "<p>none", "<table>" * 30 + "<tr><td>x"):
        columns.add_page(html, "")
    made = columns.to_arrow().to_pylist()
    assert [d["nodes"] for d in made] == [d["texts"] for d in made] == [[], [], [], []]
    assert [(r["index"], r["cells"]) for r in made[0]["tables"]] == [
        (0, [("a", "a"), ("b", "b")]),
        (0, [("a", "2 3"), ("b", "45item"), ("b_link", "/x")]),
        (1, [("col_0", "6")]), (1, [("col_0", "78"), ("col_1", "8")]), (1, [("col_0", "8")]), (2, [("col_0", "8")]),
    ]
    assert made[1]["tables"] == made[2]["tables"] == []
    assert [r["index"] for r in made[3]["tables"]] == list(range(10))


def test_cells_are_no_elements_where_tables_are_read():
    """Other elements keep their places relative to each other, their texts and their next row."""
    columns = _Columns(False, tables=True)
    columns.add_page(TABLES, "https://h/")
    (made,) = columns.to_arrow().to_pylist()
    nodes = made["nodes"]
    names = [n["tag"] for n in nodes]
    assert names == ["ul", "li", "tr", "tr", "a", "ul", "li", "tr", "tr", "td", "tr", "tr"]
    assert [n["pre"] for n in nodes] == list(range(12))
    assert [n["parent"] for n in nodes] == [-1, 0, -1, -1, -1, -1, 5, -1, -1, 8, -1, -1]
    assert [n["size"] for n in nodes] == [1, 0, 0, 3, 0, 1, 0, 0, 1, 0, 1, 0]
    assert [n["next_row"] for n in nodes] == [None, None, 3, None, None, None, None, 8, 10, None, None, None]
    assert "".join(made["texts"][nodes[6]["t0"] : nodes[6]["t0"] + nodes[6]["tn"]]) == "item"


def test_simple_pages_are_cut_as_others_are(monkeypatch):
    """Pages whose tags all end at the next `>` take a shorter way to the same elements."""
    pages = [
        TABLES, "<p>a<!-- b --><i c='d'>e</i></p>f<br/>", "x<P CLASS=a>y</p ><?z?></>", "<!doctype html> <p title=\"\">1",
        "<p a='1>2'>3", "<a href=\"<b>\">4</a>", "a < b<p>5", "<!-- <p> -->6", "<title>7</title>8", "<p",
    ]
    simple = [shred_module._simple_tokens(html) is not None for html in pages]
    assert simple == [True] * 4 + [False] * 6

    def shredded():
        columns = _Columns(False, tables=True)
        for html in pages:
            columns.add_page(html, "https://h/")
        return columns.to_arrow().to_pylist()

    short = shredded()
    monkeypatch.setattr(shred_module, "_simple_tokens", lambda html: None)
    assert short == shredded()


def test_python_cleans_texts_as_the_expression_does(spark):
    codes = [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 7)]
    texts = ["", " ", "a  b", "  x\x1c\x00", "y" * 2001, *(f" {chr(c)}a{chr(c)}{chr(c)} b " for c in codes)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", clean_text(F.col("text")).alias("c"))
    later = [r["text"] for r in rows.collect() if python_clean_text(r["text"]) != r["c"]]
    assert [t for t in later if unicodedata.category(t[1]) != "Cf"] == []


SHAPED = "<p{}>{}<table><tr><th>{}<tr><td>{}<a href=\"{}\">{}</a></table>{}<div class='{}'>x</div><!-- {} --> "
VALUES = ["a", "b  c", "&lt;d&amp;", "/e/1", "/f.g/", "../h", "é​", "i j"]


def test_pages_of_one_shape_share_their_layout(monkeypatch):
    """From the third page on the same elements, texts and rows are made without shredding."""
    rng = random.Random(3)
    pages = [SHAPED.format(" id=q", *(rng.choice(VALUES) for _ in range(8))) for _ in range(30)]
    pages += [SHAPED.format(*(rng.choice(["", " ", *VALUES]) for _ in range(9))) for _ in range(200)]

    def shredded(**how):
        columns = _Columns(False, **how)
        for html in pages:
            columns.add_page(html, "https://h/d")
        return columns.to_arrow().to_pylist()

    ways = [{}, {"tables": True}, {"tables": True, "nodes": False, "links": False}]
    monkeypatch.setattr(shred_module, "_LONGEST_LAYOUT", 0)
    alone = [shredded(**how) for how in ways]
    monkeypatch.undo()
    assert [shredded(**how) for how in ways] == alone
    calls, shred_page = [], _Columns._shred
    monkeypatch.setattr(_Columns, "_shred", lambda *args: calls.append(1) or shred_page(*args))
    assert [shredded(**how)[:30] for how in ways] == [made[:30] for made in alone]
    assert len(calls) < 600
    pages[:] = pages[:30]
    calls.clear()
    assert [shredded(**how) for how in ways] == [made[:30] for made in alone] and not calls


def test_layouts_are_bounded(monkeypatch):
    monkeypatch.setattr(shred_module, "_MOST_LAYOUT_TOKENS", 50)
    monkeypatch.setattr(shred_module, "_MOST_MET", 5)
    columns = _Columns(True)
    for n in [*range(1, 30)] * 2 + [3] * 3:
        for _ in range(2):
            columns.add_page("<p>" * n, "")
        assert sum(len(known) for known in shred_module._layouts.values()) <= 51 and len(shred_module._met) <= 5
    assert [len(d["nodes"]) for d in columns.to_arrow().to_pylist()[-6:]] == [5] * 6


def test_usual_addresses_are_resolved_as_others_are():
    bases = ["https://h/d", "http://a_b.c:80?x", "https://h", "HTTPS://H/", "https://h:x/", "ftp://a/", " https://h/", "", "https://u@h/", "https://ü/"]
    paths = ["/c/1", "/c/1/", "/", "//x/y", "/a//b", "/a.b/c", "/.a", "/a/..", "/a/./b", "/a;p", "/a?q", "/a b", "/%41~_-", "/é", "c/1", "/a/.b.", "/a\n"]
    for base in bases:
        for path in paths:
            assert shred_module._resolve(base, path) == urljoin(base, path), (base, path)
