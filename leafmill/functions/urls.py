"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.bind import bound

# An href that starts with one of these is left as it is.
ABSOLUTE_PREFIXES = ("http://", "https://", "mailto:", "javascript:")


def netloc(url: Column) -> Column:
    """The authority of a URL with user and port; '' when there is none."""
    url = F.translate(url, "\t\r\n", "")
    return F.regexp_extract(url, r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


# The schemes whose references are resolved, and those whose last
# segment may have parameters after a semicolon.
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero",
    "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
PARAMETER_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips",
    "mms", "sftp", "tel",
)
# Characters that stand for one of `/?#@:` and may not be in a host.
_DISGUISED = "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫＃／：？＠"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
# Authority, path, query, fragment of what follows the scheme (RFC 3986, appendix B).
_REST = r"(?s)^(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_LAST_PARAMETERS = r"(?s)^((?:.*/)?[^/;]*);([^/]*)$"


def _ipv6() -> str:
    """The addresses of RFC 3986, with an optional scope."""
    group = "[0-9A-Fa-f]{1,4}"
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    pair = rf"(?:{group}:{group}|{byte}(?:\.{byte}){{3}})"
    forms = [f"(?:{group}:){{6}}{pair}"]
    for after in range(5, -1, -1):
        before = f"(?:(?:{group}:){{0,{4 - after}}}{group})?" if after < 5 else ""
        forms.append(f"{before}::(?:{group}:){{{after}}}{pair}")
    forms += [f"(?:(?:{group}:){{0,5}}{group})?::{group}", f"(?:(?:{group}:){{0,6}}{group})?::"]
    return rf"^(?:{'|'.join(forms)})(?:%[^%]+)?$"


_HOST_IN_BRACKETS = rf"{_ipv6()}|(?s)^v[0-9A-Fa-f]+\..+$"


def _split(url: Column, default_scheme: Column) -> Column:
    """Scheme, authority, path, parameters, query, fragment; absent parts are ''."""
    clean = F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")

    def parts(clean: Column) -> Column:
        own = F.lower(F.rtrim(F.regexp_extract(clean, _SCHEME, 0), F.lit(":")))
        scheme = F.when(own == "", default_scheme).otherwise(own)
        rest = F.regexp_replace(clean, _SCHEME, "")
        path = F.regexp_extract(rest, _REST, 2)
        has = scheme.isin(*PARAMETER_SCHEMES) & F.rlike(path, F.lit(_LAST_PARAMETERS))
        return F.struct(
            scheme.alias("scheme"), F.regexp_extract(rest, _REST, 1).alias("authority"),
            F.when(has, F.regexp_extract(path, _LAST_PARAMETERS, 1)).otherwise(path).alias("path"),
            F.when(has, F.regexp_extract(path, _LAST_PARAMETERS, 2)).otherwise("").alias("parameters"),
            F.regexp_extract(rest, _REST, 3).alias("query"), F.regexp_extract(rest, _REST, 4).alias("fragment"),
        )

    return bound(clean, parts)


def _well_formed(authority: Column) -> Column:
    opened, closed = F.contains(authority, F.lit("[")), F.contains(authority, F.lit("]"))
    host = F.regexp_extract(authority, r"\[([^\]]*)", 1)
    return (
        ((~opened & ~closed) | (opened & closed & F.rlike(host, F.lit(_HOST_IN_BRACKETS))))
        & ~F.rlike(authority, F.lit(f"[{_DISGUISED}]"))
    )


def _built(scheme: Column, authority: Column, path: Column, parameters: Column, query: Column, fragment: Column) -> Column:
    def part(mark: str, value: Column, after: str = "") -> Column:
        return F.when(value != "", F.concat(F.lit(mark), value, F.lit(after))).otherwise("")

    whole = F.concat(path, part(";", parameters))

    def url(whole: Column) -> Column:
        rooted = F.startswith(whole, F.lit("/"))
        slash = F.when((whole != "") & ~rooted, "/").otherwise("")
        bare = F.startswith(whole, F.lit("//")) | ((scheme != "") & ((whole == "") | rooted))
        start = F.when(authority != "", F.concat(F.lit("//"), authority, slash)).when(bare, "//").otherwise("")
        return F.concat(part("", scheme, ":"), start, whole, part("?", query), part("#", fragment))

    return bound(whole, url)


def _without_dots(base: Column, path: Column) -> Column:
    """A path against the base's, its dot segments removed by a fold over the segments."""
    folder = F.split(base, "/")
    folder = F.when(F.get(folder, F.size(folder) - 1) == "", folder).otherwise(
        F.slice(folder, F.lit(1), F.size(folder) - 1)
    )
    joined = F.concat(folder, F.split(path, "/"))

    def inner(all_: Column) -> Column:
        return F.filter(all_, lambda s, i: (i == 0) | (i == F.size(all_) - 1) | (s != ""))

    segments = F.when(F.startswith(path, F.lit("/")), F.split(path, "/")).otherwise(bound(joined, inner))

    def step(done: Column, s: Column) -> Column:
        above = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s == "..", above).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    def resolved(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        last = F.get(segments, F.size(segments) - 1)
        folder = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        text = F.array_join(F.concat(kept, folder), "/")
        return F.when(text == "", "/").otherwise(text)

    return bound(segments, resolved)


def _resolved(href: Column, base: Column, given: Column) -> Column:
    """The address that split parts give (RFC 3986, section 5.2)."""
    def whole(authority: Column, path: Column, parameters: Column, query: Column) -> Column:
        return _built(given["scheme"], authority, path, parameters, query, given["fragment"])

    query = F.when(given["query"] == "", base["query"]).otherwise(given["query"])
    other = (given["scheme"] != base["scheme"]) | ~given["scheme"].isin(*RELATIVE_SCHEMES)
    return (
        F.when(~_well_formed(base["authority"]) | ~_well_formed(given["authority"]), None)
        .when(other, href)
        .when(given["authority"] != "", whole(given["authority"], given["path"], given["parameters"], given["query"]))
        .when(
            (given["path"] == "") & (given["parameters"] == ""),
            whole(base["authority"], base["path"], base["parameters"], query),
        )
        .otherwise(
            whole(base["authority"], _without_dots(base["path"], given["path"]), given["parameters"], given["query"])
        )
    )


def is_absolute(href: Column) -> Column:
    test = F.lit(False)
    for prefix in ABSOLUTE_PREFIXES:
        test = test | href.startswith(prefix)
    return test


def url_join(base: Column, href: Column) -> Column:
    """Resolve `href` against `base` (RFC 3986); NULL when either is malformed.

    Absolute hrefs and empty ones are left as they are.  All in one expression:
    both are split once, and only the case that applies is worked out.
    """
    base = F.coalesce(base, F.lit(""))
    joined = bound(
        _split(base, F.lit("")),
        lambda b: bound(_split(href, b["scheme"]), lambda given: _resolved(href, b, given)),
    )
    return F.when(href.isNull() | (href == "") | (base == "") | is_absolute(href), href).otherwise(joined)
