"""Text and URL functions against plain definitions, on random and chosen texts."""

import hashlib
import random
import re
import sys
import unicodedata
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from leafmill.functions.text import clean_text, content_hash, display_trunc, has_skip_class
from leafmill.functions.urls import netloc, url_join

SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
ODD = "\u200b\u200e\xad\ufeff\x00\x07\x7f\ue000\uffff\U0001f600é漢a-"


# What white space and invisible characters become, by example.
CLEANED = {
    None: "", "": "", " \t\n ": "", "a": "a", "  a \t\n b\u3000c ": "a b c", "a\xa0\x85\u2028b": "a b",
    "a\u200bb": "ab", " a \u200b b ": "a  b", "\u200b a": " a", "a\x1fb": "a b", "a\x00b\x7fc": "abc",
    "soft\xadhyphen": "softhyphen", "\ue000x\uffff": "x", "é漢\U0001f600": "é漢\U0001f600",
    "x" * 2001: "x" * 2000, "\U0001f600" * 2001: "\U0001f600" * 2000,
}


def visible(text):
    return [c for c in text or "" if c.isprintable() and not c.isspace()]


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_clean_text_by_example(spark):
    texts = list(CLEANED)
    got = column(spark, texts).select("i", clean_text(F.col("t")).alias("o")).collect()
    assert {texts[r["i"]]: r["o"] for r in got} == CLEANED


def test_clean_text_on_random_texts(spark):
    """Visible characters stay in order; what separates them is blanks, and only where white space was."""
    rng = random.Random(7)
    texts = ["".join(rng.choices(SPACES + ODD, k=rng.randint(1, 40))) for _ in range(3000)]
    got = column(spark, texts).select("i", clean_text(F.col("t")).alias("o")).collect()
    for r in got:
        text, out = texts[r["i"]], r["o"]
        assert visible(out) == visible(text)
        assert all(c == " " or c.isprintable() for c in out)
        assert out.count(" ") <= len(re.findall(r"\s+", text))
        words = ["".join(visible(w)) for w in re.split(r"\s+", text)]
        assert out.split() == [w for w in words if w]


def test_clean_text_on_every_assigned_code_point(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    frame = spark.range(1, sys.maxunicode + 1).filter("id not between 55296 and 57343")
    text = F.expr("concat('a', decode(unhex(lpad(hex(id), 8, '0')), 'utf-32'), 'b')")
    got = dict(frame.select("id", clean_text(text)).collect())
    newer_than_the_jvm = {0x890, 0x891, *range(0x13439, 0x13440)}

    def between(c):
        return " " if c.isspace() else c if c.isprintable() else ""

    wrong = {c for c in codes if got[c] != f"a{between(chr(c))}b"}
    assert wrong <= newer_than_the_jvm


def test_netloc(spark):
    urls = [
        "http://h", "https://u:p@h:81/x", "HTTPS://H/x?y", "//h/x", "h/x", "", "mailto:a@b",
        "http://h?x", "http://h#x", "http:///x", " http://h/x y|z", "ht\ntp://h/x", "1a://h", "a+b://h/c",
    ]
    got = column(spark, urls).select("i", netloc(F.col("t")).alias("o")).collect()
    assert [r["o"] for r in got] == [urlsplit(urls[r["i"]]).netloc for r in got]


def test_url_join(spark):
    bases = ["http://h/a/b?c#d", "https://h.example", "http://h/a/b/"]
    refs = [
        "/x", "x", "../x", "../../../x", "?q", "#f", "//h2/x", "", "tel:1", "mailto:a", "HTTP://h",
        "javascript:void(0)", "data:x", "./", "x;y?z", "é,ü", "a b", "http://[x", "JavaScript:x",
    ]
    pairs = [(b, r) for b in bases for r in refs]
    frame = spark.createDataFrame(pairs, "b string, r string")
    kept = ("http://", "https://", "mailto:", "javascript:")
    for row in frame.select("b", "r", url_join(F.col("b"), F.col("r")).alias("o")).collect():
        whole = not row["r"] or row["r"].startswith(kept)
        assert row["o"] == (row["r"] if whole else urljoin(row["b"], row["r"]))
    bad = spark.createDataFrame([("http://h/", "//[x")], "b string, r string")
    assert bad.select(url_join(F.col("b"), F.col("r"))).first()[0] is None


def _random_address(rng):
    """A reference from parts that are usual, odd or malformed."""
    def segment():
        return rng.choice(["", ".", "..", "a", "b.c", "é", " x", "a;p", ";", "..;q", "a=1", "p q"])

    scheme = rng.choice(["", "", "", "http:", "HTTP:", "https:", "ftp:", "file:", "tel:", "a-b:", "1x:", ":", "htTps:"])
    hosts = ["", "", "", "//", "//h", "//u:p@h:8", "//[::1]", "//[x", "//h]", "//[1::2:3]:80", "//[v1.a]", "//[1.2.3.4]"]
    hosts += ["//[::1.2.3.4]", "//[::1.2.3.04]", "//[1:2:3:4:5:6:7::]", "//[fe80::1%e]", "//\u2100", "//É.x", "//[]"]
    path = rng.choice(["", "/"]) + "/".join(segment() for _ in range(rng.randrange(5)))
    end = rng.choice(["", "", "?", "?q=1", "?a/b;c", "?x?y"]) + rng.choice(["", "", "#", "#top", "#a?b/c#d"])
    text = scheme + rng.choice(hosts) + path + end
    if text and rng.random() < 0.1:
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice("\n\t \r") + text[at:]
    return rng.choice(["", "", "", "\t", " \n", "\x01"]) + text


def test_url_join_on_random_addresses(spark):
    """Against the standard library; malformed addresses, which it refuses, are NULL."""
    rng = random.Random(3)
    usual = ["https://h/a/b/c;x?q#f", "http://h", "file:///a/b", "http://h/d/"]
    pairs = [(rng.choice([_random_address(rng), *usual]), _random_address(rng)) for _ in range(4000)]
    frame = spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "i int, b string, r string")
    joined = frame.select("i", url_join(F.col("b"), F.col("r")).alias("o"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

    def by_library(base, ref):
        if not ref or ref.startswith(("http://", "https://", "mailto:", "javascript:")):
            return ref
        try:
            return urljoin(base, ref)
        except ValueError:
            return None

    wrong = [(*pairs[r["i"]], r["o"]) for r in joined.collect() if r["o"] != by_library(*pairs[r["i"]])]
    assert not wrong, wrong[:5]
    odd = spark.createDataFrame([(None, "x/y"), ("http://h/", None), ("", "../x")], "b string, r string")
    assert [r[0] for r in odd.select(url_join(F.col("b"), F.col("r"))).collect()] == ["x/y", None, "../x"]


def test_content_hash_counts_absent_as_empty(spark):
    frame = spark.createDataFrame([("é", None, "s"), (None, "t", None)], "a string, b string, c string")
    got = [r[0] for r in frame.select(content_hash(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [hashlib.md5(t.encode()).hexdigest() for t in ("é||s", "|t|")]


def test_display_trunc(spark):
    frame = column(spark, ["é" * 90, None])
    got = frame.select(display_trunc(F.col("t"), 80, "nan"), display_trunc(F.col("t"), 2)).collect()
    assert [tuple(r) for r in got] == [("é" * 80, "éé"), ("nan", "")]


def test_has_skip_class(spark):
    classes = [["a", "Top-NAVbar"], ["fooTer"], ["na", "v"], [], None]
    frame = spark.createDataFrame([(c,) for c in classes], "c array<string>")
    got = [r[0] for r in frame.select(has_skip_class(F.col("c"))).collect()]
    assert got == [True, True, False, False, False]
