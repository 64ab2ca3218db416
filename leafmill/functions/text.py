"""Text functions, all plain Spark expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 2000

# White space: the Unicode property, and the four separators Python adds to it.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
# Runs that are more than one plain space; most spaces need no replacement.
_UNEVEN = rf"{SPACE}(?:(?<! ){SPACE}*+|{SPACE}++)"
# Control, format, surrogate and private code points, line and paragraph
# separators, and noncharacters.  Code points Unicode may still assign are kept:
# the JVM's tables can be older than the text.  One category test settles most
# characters, the rest of the class is only asked about the others.
_NEVER_ASSIGNED = r"\x{fdd0}-\x{fdef}" + "".join(
    rf"\x{{{plane:x}fffe}}\x{{{plane:x}ffff}}" for plane in range(17)
)
UNPRINTABLE = rf"[\p{{C}}\p{{Zl}}\p{{Zp}}&&[[^\p{{Cn}}]{_NEVER_ASSIGNED}]]"


def clean_text(text: Column, max_text: int | None = MAX_TEXT) -> Column:
    """White space runs to one space, trim, drop non-printables, cut at ``max_text`` (None: nowhere)."""
    flat = F.trim(F.regexp_replace(text, _UNEVEN, " "))
    printable = F.regexp_replace(flat, UNPRINTABLE, "")
    cut = printable if max_text is None else F.substring(printable, 1, max_text)
    return F.coalesce(cut, F.lit(""))


_SPACES = re.compile(r"\s+")
# Format characters assigned after Java 17, for which `clean_text` keeps them.
_LATER = frozenset(map(chr, [0x890, 0x891, *range(0x13439, 0x13440)]))


def _kept(char: str) -> bool:
    code = ord(char)
    if unicodedata.category(char) == "Cn":
        return not (0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE)
    return char.isprintable() or char in _LATER


def python_clean_text(text: str) -> str:
    """`clean_text` of a text that a worker has at hand."""
    if text.isascii() and text.isprintable() and "  " not in text:
        return text.strip(" ")[:MAX_TEXT]
    text = _SPACES.sub(" ", text).strip(" ")
    if not text.isprintable():
        text = "".join(filter(_kept, text))
    return text[:MAX_TEXT]


def content_hash(text: Column, type_: Column, source: Column) -> Column:
    """md5 of `text|type|source`, an absent value counting as ''."""
    parts = [F.coalesce(part, F.lit("")) for part in (text, type_, source)]
    return F.md5(F.concat_ws("|", *parts))


def display_trunc(text: Column, width: int, missing: str = "") -> Column:
    """The first `width` characters, `missing` standing for an absent value."""
    return F.substring(F.coalesce(text, F.lit(missing)), 1, width)


def has_skip_class(classes: Column) -> Column:
    """Whether a class list marks navigation, a menu, a footer or a sidebar."""
    joined = F.lower(F.array_join(F.coalesce(classes, F.array().cast("array<string>")), " "))
    return F.rlike(joined, F.lit("nav|menu|footer|sidebar"))


def join_tags(tags: Column) -> Column:
    """Tag texts, already stripped, as one comma-separated text."""
    return F.array_join(tags, ", ")
