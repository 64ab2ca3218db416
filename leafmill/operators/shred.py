"""Turn an HTML column into a document column (`schema.DOCUMENT`).

This is the engine's only per-page Python: one pass over the markup inside an
Arrow UDF that builds whole columns, no per-row Spark objects.  Everything that
is asked of a document afterwards is a Spark expression over its arrays.  Cells
of tables are named and read while a page's elements are at hand: asked of the
arrays, each of them would be looked for in the elements of its row again.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.entities import html5
from operator import itemgetter
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmill.functions.text import python_clean_text
from leafmill.functions.urls import ABSOLUTE_PREFIXES
from leafmill.schema import DOCUMENT, NODE, TABLE_ROW

MAX_TABLES = 10

# Fixed values of HTML: elements without content, those whose content is text, ...
VOID = frozenset(
    "area base basefont br col embed frame hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset("script style xmp iframe noembed noframes title textarea".split())
# Text of these counts only for the element itself, never for one around it.
HIDDEN_TEXT = frozenset("script style template rt rp".split())
HEAD_ONLY = frozenset("script style meta link title base".split())

# Fixed values of the HTML 4 recovery rules: start tags that end an open element.
# These and the end ranks below are the element tables of libxml2's HTML parser
# (MIT licence, Copyright (C) 1998-2012 Daniel Veillard), whose recovery is followed.
_BLOCKS = "address blockquote center dir div dl form h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul"
_ENDED = {
    "a": "a fieldset table td th",
    "b": "center p td th",
    "big s small strike tt": "p",
    "u": "p td th",
    "i": "center",
    "font": "center td th",
    "span": "td th",
    "address dir menu": "dd dl dt form li ul",
    "dd": "dt",
    "dt": "dd dl",
    "dl": "form li",
    "ol": "form",
    "ul": "address form menu ol pre",
    "li": "li",
    "form": "form",
    "hr": "form",
    "legend": "fieldset",
    "option": "optgroup option",
    "h1 h2 h3 h4 h5 h6": "fieldset form li p table",
    "p": "address blockquote body caption center col colgroup dd dir div dl dt fieldset form"
    " frameset h1 h2 h3 h4 h5 h6 head hr li listing menu multicol ol p pre table tbody td"
    " tfoot th title tr ul xmp",
    "pre": "dd dl dt fieldset form li table ul",
    "caption": "col colgroup tbody tfoot thead tr",
    "col colgroup": "col colgroup tbody tfoot thead tr",
    "thead tbody": "tbody tfoot",
    "tfoot": "tbody",
    "tr": "tbody tfoot tr",
    "td th": "tbody td tfoot th tr",
    "head": "a abbr acronym address b bdo big blockquote body br center cite code dd dfn dir div"
    " dl dt em fieldset font form frameset h1 h2 h3 h4 h5 h6 hr i iframe img kbd li listing map"
    " menu ol p pre q s samp small span strike strong sub sup table tt u ul var xmp",
    "title style link": "body frameset",
    "script": "noscript",
}
ENDED_BY = {
    tag: frozenset(ends.split()) for tags, ends in _ENDED.items() for tag in tags.split()
}
# An end tag reaches past open elements of lower or equal rank only.
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
    "table": 190, "head": 200, "body": 200, "html": 220,
}
_PLAIN_RANK = 100

# Elements an extractor asks for; others are kept only when they carry a class.
WANTED = frozenset(
    "title meta h1 h2 h3 h4 h5 h6 p a ul ol li table tr td th time".split()
)

# Elements that tables are read from.
_TABLE_PARTS = frozenset("table tr td th a".split())

# Empty elements that neither end another one nor are asked for.
_PASSED_OVER = frozenset("area br embed img input param source track wbr".split())

# A text, then the markup it ends at: a tag, a comment or declaration, or the end.
# A `<` that starts no markup is text.
_MARKUP = re.compile(
    r"([^<]*+(?:<(?![a-zA-Z!?/])[^<]*+)*+)"
    r"(?:<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)"
    r"|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+>?)|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/=][^\s/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(\S++)))?""")
# Fields that few elements have.
_RARE = ("classes", "href", "link", "name", "content", "next_row")
# Elements whose end tag counts for nothing, and those a page has one of.
_LASTING = frozenset(("html", "body"))
_ONCE = frozenset(("html", "head", "body"))
_NO_ATTRIBUTES: dict[str, str] = {}
# An element while a page is shredded: what ends it, its place and those of its end and its
# holder (-1: not kept), its texts, its last row, and for a row the place of the next.
_TAG, _ENDS, _NODE, _END, _TEXT, _TEXT_END, _PARENT, _ATTRIBUTES, _LAST_ROW, _NEXT_ROW = range(10)
_CELLS = frozenset(("td", "th"))
_ONLY_TABLES = frozenset(("table", "td", "th"))
_NO_HOLDER = ["", (), -1, 0, 0, 0, -1, {}, None, None]
_KEPT_ATTRIBUTES = ("class", "href", "name", "content")
_REFERENCE = re.compile(r"&#?[0-9a-zA-Z]++(?:;|(?!=))")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TEXT}
# A tag that ends at the next `>`.
_SIMPLE_TAG = re.compile(r"<([^<>]*+)>")
# A start tag with one attribute in its most usual spelling.
_USUAL_TAG = re.compile(r"([a-zA-Z][a-zA-Z0-9]*+) ([a-zA-Z]++)=\"([^\"&]*+)\"\Z")
# An address whose host an absolute path is put behind as it stands, and such a path: no segment begins with a dot.
_USUAL_HOST = re.compile(r"https?://[a-zA-Z0-9._-]++(?::[0-9]++)?+(?=[/?#]|\Z)")
_USUAL_PATH = re.compile(r"(?:/(?!\.)[a-zA-Z0-9._~%-]++)++/?\Z")
# What stands between `<` and the next `>` when that is a whole tag: no quote of a value is open.
_WHOLE_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)\Z")
_WHOLE_COMMENT = re.compile(r"!--(?:-?|.*--!?)\Z|(?!!--|/[a-zA-Z])[!?/]", re.S)
# Pages up to this length are cut into tokens at once.
_SHORT_PAGE = 100_000


def _decode_reference(match: re.Match) -> str:
    """In an attribute `&copy` counts as a reference only when it stands alone."""
    written = match[0]
    whole = written[1] == "#" or written[-1] == ";" or written[1:] in html5
    return unescape(written) if whole else written


def _attributes(source: str) -> dict[str, str]:
    """The kept attributes of a start tag; the first of a repeated name counts."""
    found: dict[str, str] = {}
    if not source or source.isspace():
        return found
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in _KEPT_ATTRIBUTES and name not in found:
            value = double or single or bare
            found[name] = _REFERENCE.sub(_decode_reference, value) if "&" in value else value
    return found


# The same short attributes stand on many elements.
_short_attributes = lru_cache(maxsize=4096)(_attributes)
_SHORT = 64
_MOST_KNOWN = 4096
_LONGEST_REASON = 300


def _given(source: str) -> dict[str, str]:
    """`_attributes`, remembered when short."""
    if not source:
        return _NO_ATTRIBUTES
    return _short_attributes(source) if len(source) < _SHORT else _attributes(source)


_NO_TAG = (None, None, None, "!")


def _tag(written: str) -> tuple | None:
    """`(end tag?, tag, attributes, sign)` of what stands in a tag; without a tag for comments; None: look closer.

    The sign tells tags apart as far as they shape a page.
    """
    if found := _USUAL_TAG.match(written):
        tag, name, value = found.groups()
        closing, given = "", {name.lower(): value} if name.lower() in _KEPT_ATTRIBUTES else _NO_ATTRIBUTES
        tag = tag.lower()
    elif found := _WHOLE_TAG.match(written):
        closing, tag, attributes = found.groups()
        tag = tag.lower()
        if closing:
            return closing, tag, _NO_ATTRIBUTES, f"/{tag}"
        given = None if tag in RAW_TEXT else _given(attributes)
    else:
        return _NO_TAG if _WHOLE_COMMENT.match(written) else None
    if tag in RAW_TEXT:
        return None
    return closing, tag, given, tag + (" ." if given.get("class") else " " if given else "")


class _LookCloser(Exception):
    """A tag that may not end at the next `>`."""


class _KnownTags(dict):
    """What `_tag` says of what was written, remembered when short."""

    def __missing__(self, written: str) -> tuple:
        if (tag := _tag(written)) is None:
            raise _LookCloser
        if len(written) < _SHORT:
            if len(self) >= _MOST_KNOWN:
                self.clear()
            self[written] = tag
        return tag


_known_tags = _KnownTags()


def _simple_tokens(html: str) -> tuple[list[str], list[tuple]] | None:
    """The texts and the tags after them, as `_tag` has them, of a page whose tags all end at the next `>`; None for others."""
    if len(html) > _SHORT_PAGE:
        return None
    pieces = _SIMPLE_TAG.split(html)
    if len(pieces) // 2 != html.count("<"):
        return None
    try:
        tags = [*map(_known_tags.__getitem__, pieces[1::2]), _NO_TAG]
    except _LookCloser:
        return None
    return pieces[::2], tags


class _Mark(str):
    """Stands for the text of the token ``at`` while a layout is made."""

    at: int


class _Given(dict):
    """Stands for the attributes of the token ``at`` while a layout is made."""

    at: int


class _Layout:
    """What pages of one shape have in common: all but their texts and the values of attributes.

    Texts and attributes are named by the places of their tokens.
    """

    def __init__(self, kept: list[list], shown: list[list], texts: list[_Mark], tables: bool):
        self.texts = [text.at for text in texts]
        self.spans, parts = _table_parts(kept) if tables else ([], [])
        self.tables = [
            (index, headers, [[(span, None if a is None else a.at) for span, a in row] for row in rows])
            for index, headers, rows in parts
        ]
        self.nodes = _node_fields(shown)
        self.given = [(i, e[_ATTRIBUTES].at, e[_TAG]) for i, e in enumerate(shown) if e[_ATTRIBUTES]]
        self.next_rows = [(i, e[_NEXT_ROW]) for i, e in enumerate(shown) if e[_NEXT_ROW] is not None]


# Layouts by shape, for each way to shred, and shapes met once. Of all layouts together the tokens are bounded.
_layouts: dict[tuple, dict[tuple, _Layout]] = {}
_met: set[int] = set()
_layout_tokens = 0
_MOST_LAYOUT_TOKENS = 100_000
_LONGEST_LAYOUT = 2_000
_MOST_MET = 10_000
_sign = itemgetter(3)


def _node_fields(kept: list[list]) -> tuple[list, ...]:
    """Tags, parents, sizes, first texts and numbers of texts of elements."""
    return (
        [e[_TAG] for e in kept], [e[_PARENT] for e in kept], [e[_END] - i for i, e in enumerate(kept, 1)],
        [e[_TEXT] for e in kept], [e[_TEXT_END] - e[_TEXT] for e in kept],
    )


def _table_parts(kept: list[list]) -> tuple[list[tuple[int, int]], list[tuple]]:
    """The spans of texts that the first ``MAX_TABLES`` tables are read from, and the tables.

    A table is its number, the spans of its headers, and its rows: for each cell
    its span and the attributes of its first link, if any.
    """
    tags = [e[_TAG] for e in kept]
    spans: dict[int, int] = {}

    def span(node: int) -> int:
        return spans.setdefault(node, len(spans))

    parts = []
    for index, table in enumerate([node for node, tag in enumerate(tags) if tag == "table"][:MAX_TABLES]):
        headers, rows = [], []
        for node in range(table + 1, kept[table][_END]):
            if (tag := tags[node]) == "th":
                headers.append(span(node))
            elif tag == "tr":
                cells = [n for n in range(node + 1, kept[node][_END]) if tags[n] in _CELLS]
                rows.append([(span(n), _first_link(kept, tags, n)) for n in cells])
        parts.append((index, headers, rows))
    return [(kept[node][_TEXT], kept[node][_TEXT_END]) for node in spans], parts


def _first_link(kept: list[list], tags: list[str], cell: int) -> dict[str, str] | None:
    for below in range(cell + 1, kept[cell][_END]):
        if tags[below] == "a":
            return kept[below][_ATTRIBUTES]
    return None


def _resolve(base: str, href: str) -> str | None:
    """`href` against the page address; None when it cannot be resolved."""
    if not href or href.startswith(ABSOLUTE_PREFIXES):
        return href
    if _USUAL_PATH.match(href) and (host := _USUAL_HOST.match(base)):
        return host[0] + href
    try:
        return urljoin(base, href)
    except ValueError:
        return None


class _Columns:
    """Column buffers of one batch; a page appends its elements and texts.

    What few elements have is kept by element; addresses are resolved only where
    ``links`` are asked for, the rows of tables are made only with ``tables``, and
    without ``nodes`` they are all that is made.  Where they are made, tables and
    cells without a class are no elements of their own any more.
    """

    def __init__(self, keep_all: bool, links: bool = True, tables: bool = False, nodes: bool = True):
        self.keep_all, self.links, self.tables, self.nodes = keep_all, links, tables, nodes
        self.wanted = WANTED if nodes else _TABLE_PARTS
        self.layouts = _layouts.setdefault((keep_all, tables, nodes), {})
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.sizes: list[int] = []
        self.first_texts: list[int] = []
        self.text_counts: list[int] = []
        self.rare: dict[str, dict[int, object]] = {name: {} for name in _RARE}
        self.texts: list[str] = []
        self.node_offsets = [0]
        self.text_offsets = [0]
        self.errors: list[str | None] = []
        # Rows of tables: per page the end of its rows, per row its table and the end of its cells.
        self.row_offsets = [0]
        self.row_tables: list[int] = []
        self.cell_offsets = [0]
        self.cell_names: list[str] = []
        self.cell_values: list[str] = []

    def add_page(self, html: str | None, base: str | None) -> None:
        """A page that cannot be shredded has no elements but the reason: it must not end the others' job."""
        error = None
        try:
            if html:
                tokens = _simple_tokens(html)
                if tokens is not None and (layout := self._layout(*tokens)) is not None:
                    self._fill(layout, *tokens, base or "")
                else:
                    self._add_shredded(*self._shred(html, tokens), base or "")
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:_LONGEST_REASON]
            nodes, rows = self.node_offsets[-1], self.row_offsets[-1]
            for column in (self.tags, self.parents, self.sizes, self.first_texts, self.text_counts):
                del column[nodes:]
            del self.texts[self.text_offsets[-1] :], self.row_tables[rows:], self.cell_offsets[rows + 1 :]
            del self.cell_names[self.cell_offsets[-1] :], self.cell_values[self.cell_offsets[-1] :]
            self.rare = {name: {i: v for i, v in of.items() if i < nodes} for name, of in self.rare.items()}
        self.errors.append(error)
        self.node_offsets.append(len(self.tags))
        self.text_offsets.append(len(self.texts))
        self.row_offsets.append(len(self.row_tables))

    def _shown(self, kept: list[list]) -> list[list]:
        """The elements without those that only tables are read from, their places counted anew."""
        place, n = [], 0
        for e in kept:
            place.append(n)
            n += e[_TAG] not in _ONLY_TABLES or bool(e[_ATTRIBUTES] and e[_ATTRIBUTES].get("class"))
        place.append(n)
        shown = []
        for i, e in enumerate(kept):
            if place[i] == place[i + 1]:
                continue
            e = e.copy()
            holder, below = e[_PARENT], e[_NEXT_ROW]
            e[_PARENT] = place[holder] if holder >= 0 and place[holder] < place[holder + 1] else -1
            e[_END] = place[e[_END]]
            e[_NEXT_ROW] = below if below is None else place[below]
            shown.append(e)
        return shown

    def _layout(self, texts: list[str], tags: list[tuple]) -> _Layout | None:
        """The layout of pages whose tokens show like these; None when there is none yet.

        It is made from the second such page on, by shredding stand-ins of its tokens.
        """
        global _layout_tokens
        if len(tags) > _LONGEST_LAYOUT:
            return None
        shape = (*map(_sign, tags), *map(bool, texts), *map(str.isspace, texts))
        if (found := self.layouts.get(shape)) is not None:
            return found
        if (once := hash(shape)) not in _met:
            if len(_met) >= _MOST_MET:
                _met.clear()
            _met.add(once)
            return None
        marks, stand_ins = [], []
        for at, (text, (closing, tag, given, sign)) in enumerate(zip(texts, tags)):
            mark = _Mark("" if not text else " " if text.isspace() else "x")
            stand_in = _Given({name: name for name in given or () if name != "class" or given[name]})
            mark.at = stand_in.at = at
            marks.append(mark)
            stand_ins.append((closing, tag, stand_in, sign))
        kept, counted = self._shred("", (marks, stand_ins))
        layout = _Layout(kept, self._nodes_of(kept), counted, self.tables)
        _layout_tokens += len(tags)
        if _layout_tokens > _MOST_LAYOUT_TOKENS:
            for known in _layouts.values():
                known.clear()
            _layout_tokens = len(tags)
        self.layouts[shape] = layout
        return layout

    def _fill(self, layout: _Layout, found: list[str], tags: list[tuple], base: str) -> None:
        """Add a page of this layout."""
        texts = [unescape(text) if "&" in (text := found[at]) else text for at in layout.texts]
        if layout.tables:
            self._add_rows(layout.spans, layout.tables, texts, lambda at: tags[at][2].get("href"))
        if self.nodes:
            first = self._add_nodes(layout.nodes, texts)
            for node, at, tag in layout.given:
                self._add_attributes(first + node, tags[at][2], tag, base)
            for node, below in layout.next_rows:
                self.rare["next_row"][first + node] = below

    def _add_shredded(self, kept: list[list], texts: list[str], base: str) -> None:
        if self.tables:
            self._add_rows(*_table_parts(kept), texts, lambda attributes: attributes.get("href"))
        if self.nodes:
            shown = self._nodes_of(kept)
            first = self._add_nodes(_node_fields(shown), texts)
            for node, e in enumerate(shown, first):
                if attributes := e[_ATTRIBUTES]:
                    self._add_attributes(node, attributes, e[_TAG], base)
                if e[_NEXT_ROW] is not None:
                    self.rare["next_row"][node] = e[_NEXT_ROW]

    def _nodes_of(self, kept: list[list]) -> list[list]:
        return self._shown(kept) if self.tables and self.nodes and not self.keep_all else kept

    def _add_nodes(self, fields: tuple[list, ...], texts: list[str]) -> int:
        """Add elements and the texts of their page; the place of the first."""
        first = len(self.tags)
        tags, parents, sizes, first_texts, text_counts = fields
        self.tags += tags
        self.parents += parents
        self.sizes += sizes
        self.first_texts += first_texts
        self.text_counts += text_counts
        self.texts += texts
        return first

    def _add_attributes(self, node: int, attributes: dict[str, str], tag: str, base: str) -> None:
        rare = self.rare
        if classes := attributes.get("class"):
            rare["classes"][node] = classes.split()
        if (href := attributes.get("href")) is not None:
            rare["href"][node] = href
            if self.links and tag == "a":
                rare["link"][node] = _resolve(base, href)
        if "name" in attributes:
            rare["name"][node] = attributes["name"]
        if "content" in attributes:
            rare["content"][node] = attributes["content"]

    def _add_rows(self, spans: list[tuple[int, int]], tables: list[tuple], texts: list[str], href_of) -> None:
        """The rows of these tables (see `_table_parts`); ``href_of`` what stands for a link's attributes.

        A cell is named by its header and followed by its first link, if that has
        an address; of one name the last value counts, in the place of the first.
        """
        read = [
            python_clean_text(texts[start] if end - start == 1 else "".join(texts[start:end])) for start, end in spans
        ]
        for index, headers, rows in tables:
            names = [read[span] for span in headers]
            for row in rows:
                cells: dict[str, str] = {}
                for i, (span, link) in enumerate(row):
                    name = names[i] if i < len(names) else f"col_{i}"
                    cells[name] = read[span]
                    if link is not None and (href := href_of(link)):
                        cells[f"{name}_link"] = href
                if cells:
                    self.cell_names += cells
                    self.cell_values += cells.values()
                    self.row_tables.append(index)
                    self.cell_offsets.append(len(self.cell_names))

    def _shred(self, html: str, tokens: tuple[list[str], list[tuple]] | None) -> tuple[list[list], list[str]]:
        """The kept elements of a page, as lists of the fields named by ``_TAG`` and so on, and its texts."""
        keep_all, wanted, by_class = self.keep_all, self.wanted, self.nodes
        kept: list[list] = []
        texts: list[str] = []
        stack: list[list] = []  # open elements
        head_seen = body_seen = False
        hidden = 0  # open elements whose text does not count

        def close() -> None:
            nonlocal hidden
            element = stack.pop()
            element[_END] = len(kept)
            element[_TEXT_END] = len(texts)
            if hidden and element[_TAG] in HIDDEN_TEXT:
                hidden -= 1

        def put(tag: str, attributes: dict[str, str]) -> None:
            nonlocal hidden
            node, n = len(kept), len(texts)
            holder = stack[-1] if stack else _NO_HOLDER
            if tag in wanted or keep_all or (by_class and attributes and attributes.get("class")):
                element = [tag, ENDED_BY.get(tag, ()), node, node + 1, n, n, holder[_NODE], attributes, None, None]
                kept.append(element)
                if tag == "tr" and stack:
                    if holder[_LAST_ROW] is not None:
                        holder[_LAST_ROW][_NEXT_ROW] = node
                    holder[_LAST_ROW] = element
            else:
                element = [tag, ENDED_BY.get(tag, ()), -1, 0, n, n, -1, attributes, None, None]
            if tag not in VOID:
                stack.append(element)
                if tag in HIDDEN_TEXT:
                    hidden += 1

        def start(tag: str, attributes: dict[str, str]) -> None:
            """Open an element, with the ends and the elements it implies."""
            nonlocal head_seen, body_seen
            while stack and tag in stack[-1][_ENDS]:
                close()
            if tag == "html":
                if stack:
                    return
            elif not stack:
                put("html", _NO_ATTRIBUTES)
            if tag == "head":
                if head_seen or body_seen:
                    return
                head_seen = True
            elif tag == "body":
                if body_seen:
                    return
                body_seen = True
            elif not body_seen and tag not in ("html", "frameset", "frame"):
                if tag in HEAD_ONLY:
                    if len(stack) == 1 and not head_seen:
                        put("head", _NO_ATTRIBUTES)
                        head_seen = True
                elif not any(e[_TAG] == "head" for e in stack):
                    put("body", _NO_ATTRIBUTES)
                    body_seen = True
            put(tag, attributes)

        def open_tag(tag: str, attributes: dict[str, str]) -> None:
            if body_seen and tag in _PASSED_OVER and not keep_all:
                return
            if body_seen and stack and tag not in _ONCE:
                while stack and tag in stack[-1][_ENDS]:
                    close()
                put(tag, attributes)
            else:
                start(tag, attributes)

        def add_text(text: str) -> None:
            if not body_seen and (not stack or stack[-1][_TAG] in ("html", "head")):
                if not text.isspace():
                    start("p", _NO_ATTRIBUTES)  # bare text opens a paragraph
                elif stack:
                    return
            if not hidden:
                texts.append(unescape(text) if "&" in text else text)

        def end(tag: str) -> None:
            if tag in _LASTING:
                return  # later content still belongs to the body
            rank = END_RANK.get(tag, _PLAIN_RANK)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][_TAG] == tag:
                    while len(stack) > depth:
                        close()
                    return
                if END_RANK.get(stack[depth][_TAG], _PLAIN_RANK) > rank:
                    return

        if tokens is not None:
            for text, (closing, tag, given, _) in zip(*tokens):
                if text:
                    if not body_seen:
                        add_text(text)
                    elif not hidden:
                        texts.append(unescape(text) if "&" in text else text)
                if closing is None:
                    continue
                if not closing:
                    open_tag(tag, given)
                elif stack and stack[-1][_TAG] == tag and tag not in _LASTING:
                    element = stack.pop()
                    element[_END] = len(kept)
                    element[_TEXT_END] = len(texts)
                    if hidden and tag in HIDDEN_TEXT:
                        hidden -= 1
                else:
                    end(tag)
            html = ""
        at = 0
        while at is not None:
            resume = None
            for token in _MARKUP.finditer(html, at):
                text, closing, tag, attributes, complete = token.groups()
                if text:
                    add_text(text)
                if not complete:
                    continue  # a comment, a declaration, or a tag the page breaks off in
                tag = tag.lower()
                if closing:
                    if stack and stack[-1][_TAG] == tag and tag not in _LASTING:
                        close()
                    else:
                        end(tag)
                    continue
                open_tag(tag, _given(attributes))
                if tag in RAW_TEXT and stack and stack[-1][_TAG] == tag:
                    stop = _RAW_END[tag].search(html, token.end())
                    resume = stop.start() if stop else len(html)
                    raw = html[token.end() : resume]
                    if raw and not hidden:
                        decode = tag in ("title", "textarea") and "&" in raw
                        texts.append(unescape(raw) if decode else raw)
                    break
            at = resume
        while stack:
            close()
        return kept, texts

    def to_arrow(self) -> pa.Array:
        if not self.nodes:
            empty = pa.array([[]] * len(self.errors), to_arrow_type(DOCUMENT["nodes"].dataType))
            texts = pa.array([[]] * len(self.errors), pa.list_(pa.string()))
            return pa.StructArray.from_arrays(
                [empty, texts, pa.array(self.errors, pa.string()), self._table_rows()], names=DOCUMENT.names
            )
        n, offsets = len(self.tags), np.array(self.node_offsets)
        columns: dict[str, object] = {
            "pre": np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)),
            "parent": self.parents, "size": self.sizes,
            "t0": self.first_texts, "tn": self.text_counts, "tag": self.tags,
        }
        arrays = {f.name: to_arrow_type(f.dataType) for f in NODE}
        for name, kind in arrays.items():
            if name in columns:
                columns[name] = pa.array(columns[name], kind)
                continue
            # Few elements have a value, so only these are made into an array.
            of, place = self.rare[name], np.full(n, -1)
            place[np.fromiter(of, int, len(of))] = np.arange(len(of))
            columns[name] = pa.array(list(of.values()), kind).take(pa.array(place, mask=place < 0))
        nodes = pa.StructArray.from_arrays(
            [columns[name] for name in arrays], fields=[pa.field(name, kind) for name, kind in arrays.items()]
        )
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(self.node_offsets, pa.int32()), nodes),
                pa.ListArray.from_arrays(
                    pa.array(self.text_offsets, pa.int32()), pa.array(self.texts, pa.string())
                ),
                pa.array(self.errors, pa.string()),
                self._table_rows(),
            ],
            names=DOCUMENT.names,
        )

    def _table_rows(self) -> pa.Array:
        kinds = [to_arrow_type(f.dataType) for f in TABLE_ROW]
        if not self.tables:
            return pa.nulls(len(self.errors), pa.list_(to_arrow_type(TABLE_ROW)))
        cells = pa.MapArray.from_arrays(
            pa.array(self.cell_offsets, pa.int32()),
            pa.array(self.cell_names, pa.string()), pa.array(self.cell_values, pa.string()),
        )
        rows = pa.StructArray.from_arrays(
            [pa.array(self.row_tables, pa.int32()), cells.cast(kinds[1])],
            fields=[pa.field(f.name, kind) for f, kind in zip(TABLE_ROW, kinds)],
        )
        return pa.ListArray.from_arrays(pa.array(self.row_offsets, pa.int32()), rows)


def _shredder(keep_all: bool, links: bool, tables: bool, nodes: bool):
    @F.arrow_udf(DOCUMENT)
    def shred_batch(html: pa.Array, url: pa.Array) -> pa.Array:
        columns = _Columns(keep_all, links, tables, nodes)
        for markup, base in zip(html.to_pylist(), url.to_pylist()):
            columns.add_page(markup, base)
        return columns.to_arrow()

    return shred_batch


def shred(
    html: Column | str, url: Column | str, keep_all: bool = False, links: bool = True, tables: bool = False,
    nodes: bool = True,
) -> Column:
    """The document column of an HTML column; `url` is the base of its links.

    Elements no extractor can ask for are left out unless ``keep_all``; links are
    resolved, and the rows of tables made, only if asked for.  With ``tables`` there
    are no elements for tables and cells without a class, and without ``nodes`` a
    document holds the rows of its tables and nothing else.
    """
    return _shredder(keep_all, links, tables, nodes)(html, url)
