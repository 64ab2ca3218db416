"""Tables the queries need, derived by Spark from the given ones.

The given pages hold no tables, records or meta tags, so pages with such markup
are rendered from the rows of other tables: one page per row, no grouping, the
whole text of every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import files


# Bytes of a table's file that one task gets, so that a task does as much of a large table as of a small one.
TASK_BYTES = 2 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, dealt to all cores: its file is one row group, so Spark reads it in one task."""
    path = f"{folder}/{name}.parquet"
    tasks = max(spark.sparkContext.defaultParallelism, -(-files.size(spark, path) // TASK_BYTES))
    return spark.read.parquet(path).repartition(tasks)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def _escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.replace(text, F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit('"'), F.lit("&quot;"))


def _html(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint").cast("string")


def _with_lines(frame: DataFrame) -> DataFrame:
    """Add the lines of `text` as a column, so that a text is split once."""
    return frame.withColumn("lines", F.split("text", "\n"))


def _lines(render) -> Column:
    return F.array_join(F.transform("lines", render), "\n")


def _page(page_id: Column, site: str, html: Column) -> list[Column]:
    url = F.concat(F.lit(f"https://{site}.example.org/item/"), page_id.cast("string"))
    return [page_id.cast("bigint").alias("page_id"), url.alias("url"), html.alias("html")]


def message_id() -> Column:
    return F.col("conv_id") * 1000 + F.col("turn")


def quote_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per message; every line a quote, every second one without author."""
    tags = _html(
        '<div class="tags"><a class="tag" href="/tag/role"> ', F.col("role"),
        ' </a>, <a class="tag">turn\n<i>', _text("turn"), " </i></a></div>",
    )

    def quote(line: Column, i: Column) -> Column:
        author = _html('<span>by <small class="author">', F.col("role"), "</small></span>")
        return _html(
            '<div class="quote big"><span class="text">\n  "', _escape(line), '"</span>',
            F.when(i % 2 == 0, author).otherwise(""), tags, "</div>",
        )

    html = _html('<html><body><div class="quote">no text here</div>', _lines(quote))
    return _with_lines(table(spark, folder, "conversations")).select(*_page(message_id(), "quotes", html))


def book_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per part with two editions of it."""

    def book(suffix: str, rating: Column) -> Column:
        return _html(
            '<article class="product_pod">', rating, f'<h3><a href="../{suffix}/', _text("p_partkey"),
            '.html" title="long title">', F.col("p_name"), f" {suffix}</a></h3>",
            '<div class="product_price"><p class="price_color">£', _cents("p_retailprice"),
            "</p></div></article>",
        )

    stars = _html('<p class="star-rating ', F.col("p_type"), '"></p>')
    html = _html("<ol><li>", book("hardback", stars), "</li><li>", book("paper", F.lit("")), "</ol>")
    return table(spark, folder, "part").select(*_page(F.col("p_partkey"), "books", html))


def job_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per customer; customers in debt name no date."""
    posted = _html('<p><time datetime="x">', _cents("c_acctbal"), "</time></p>")
    html = _html(
        '<div class="card"><div class="card-content"><h2 class="title is-5">',
        F.initcap("c_mktsegment"), ' Lead</h2><h3 class="subtitle company">', F.col("c_name"),
        '</h3><p class="location">\n  Nation ', _text("c_nationkey"), "\n</p>",
        F.when(F.col("c_acctbal") >= 0, posted).otherwise(""),
        '</div><div class="card-content"><p class="location">no title</p></div></div>',
    )
    return table(spark, folder, "customer").select(*_page(F.col("c_custkey"), "jobs", html))


def product_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per part with one card that has ratings and one that has none."""
    stars = F.expr("repeat('<span class=\"ws-icon ws-icon-star\"></span>', p_size % 6)")
    html = _html(
        '<div class="thumbnail"><div class="caption"><h4>was more</h4><h4 class="price">$',
        _cents("p_retailprice"), '</h4><h4><a class="title" href="/p/', _text("p_partkey"), '">',
        F.col("p_name"), '</a></h4><p class="description card-text">', F.col("p_brand"), ", ",
        F.col("p_type"), '</p></div><div class="ratings"><p class="pull-right">3 reviews</p><p>',
        stars, '</p></div></div><div class="thumbnail"><h4>$1</h4><a class="title">', F.col("p_type"),
        "</a></div>",
    )
    return table(spark, folder, "part").select(*_page(F.col("p_partkey"), "products", html))


def news_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per document; every line a story, the last story without details."""

    def story(line: Column, i: Column) -> Column:
        details = _html(
            '\n<!-- details --><tr><td><span class="score">', i.cast("string"),
            ' points</span> <span class="age">', F.col("lang"), "</span></td></tr>",
        )
        return _html(
            '<tr class="athing"><td><span class="titleline"><a href="s?id=', i.cast("string"), '">',
            _escape(line), "</a> (<b>site</b>)</span></td></tr>",
            F.when(i < F.size("lines") - 1, details).otherwise(""),
        )

    html = _html("<table>", _lines(story), "</table>")
    return _with_lines(table(spark, folder, "documents")).select(*_page(F.col("doc_id"), "news", html))


def table_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per order: a table with headers, one without, one renaming fields."""
    key, customer = _text("o_orderkey"), _text("o_custkey")
    html = _html(
        "<table><thead><tr><th>Order</th><th>Customer</th><th>Order</th></tr></thead><tr><td>", key,
        '</td><td><a href="/c/', customer, '">Customer <b>', customer, "</b></a></td><td>",
        F.col("o_orderstatus"), "</td><td>", F.col("o_orderpriority"), "</td></tr><tr></tr></table>",
        "<table><tr><td>", _cents("o_totalprice"), '<td><a href="">none</a></table>',
        "<table><tr><th>source<th>text<th>price<tr><td>Order ", key, "<td>Priority ",
        F.col("o_orderpriority"), "<td>", _cents("o_totalprice"), "</table>",
    )
    return table(spark, folder, "orders").select(*_page(F.col("o_orderkey"), "orders", html))


def many_table_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per part with thirteen tables: one, one with a table in its cell, and ten more."""
    key = _text("p_partkey")

    def numbered(i: int) -> Column:
        return _html(f"<table><tr><th>no<th>{i} in all<tr><td>table {i} of ", key, "</table>")

    inner = _html("<table><tr><td>inner ", key, "</td></tr></table>")
    html = _html(
        "<table><tr><td>first ", key, "</table><table><tr><td>outer ", key, " ", inner, "</td><td>",
        F.col("p_brand"), "</td></tr></table>", *[numbered(i) for i in range(3, 13)],
    )
    return table(spark, folder, "part").select(*_page(F.col("p_partkey"), "many", html))


def meta_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per document whose text is its description."""
    html = _html(
        '<head><meta charset="utf-8"><meta NAME="Description" content="', _escape(F.col("text")),
        '"><meta property="og:title" content="no"><meta name="keywords" content=\'', F.col("lang"),
        "'><meta name=author content=", F.col("source"), '><meta name="author" content="">',
        '<meta name="author" content="  "><title>', F.col("source"), " ", F.col("lang"),
        "</title><title>second</title></head>",
    )
    return table(spark, folder, "documents").select(*_page(F.col("doc_id"), "meta", html))


def outline_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per message: its lines as headings of level 3 and 2 and as nested lists."""

    def heading(line: Column, i: Column) -> Column:
        level = F.when(i % 2 == 0, "3").otherwise("2")
        return _html("<h", level, ">", _escape(line), "</h", level, ">")

    def entry(line: Column, i: Column) -> Column:
        return _html(
            '<li><b><a href="#l', i.cast("string"), '">', _escape(line), "</a></b>",
            '<ul><li>inner of ', i.cast("string"), " in the list</ul>",
        )

    html = _html(
        _lines(heading), "<ol>", _lines(entry), "</ol>",
        '<div class="Main-NAV x"><ul><li>a navigation entry</li></ul></div>',
    )
    return _with_lines(table(spark, folder, "conversations")).select(*_page(message_id(), "outline", html))


def document_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt")
    )


def message_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        message_id().alias("prompt_id"), F.col("text").alias("prompt")
    )


def _target(*values: Column | str | None) -> Column:
    """A target with the given (url, source_name, description); the rest is absent."""
    names = ["url", "source_name", "description"]
    padded = [*values, *[None] * (len(names) - len(values))]
    return F.struct(
        *[
            (v if isinstance(v, Column) else F.lit(v)).cast("string").alias(n)
            for n, v in zip(names, padded)
        ]
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """A reply per message, its shape chosen by the conversation.

    One shape repeats a name and ends in half a surrogate pair; it is JSON whatever
    the role holds, and without a role names nothing.
    """
    plan = F.to_json(
        F.struct(
            F.col("text").alias("project_description"),
            F.when(F.col("turn") > 0, F.col("role")).alias("data_type"),
            F.array(
                _target(
                    F.concat(F.lit("https://a.example.org:8080/"), _text("conv_id")), "", F.col("role")
                ),
                _target(F.concat(F.lit("https://b.example.org/?t="), _text("turn")), F.col("role")),
                _target(None, "No address"),
            ).alias("urls"),
            F.array(F.lit("text"), F.col("role")).alias("target_columns"),
            F.col("turn").alias("estimated_rows"),
        )
    )
    shape = F.col("conv_id") % 8
    given = F.to_json(F.struct(F.col("role").alias("data_type")))
    raw = (
        F.when(shape == 0, plan)
        .when(shape == 1, _html(" \n```json\n", plan, "\n```\n"))
        .when(shape == 2, _html("```  ", plan, "```"))
        .when(shape == 3, _html("Here it is: ", plan))
        .when(shape == 4, _html(plan, " Enjoy!"))
        .when(shape == 5, _html("[", plan, "]"))
        .when((shape == 6) & F.col("role").isNull(), given)
        .when(shape == 6, _html('{"data_type": "cut", ', F.substring(given, 2, F.length(given) - 3), ' \\ud83d"}'))
        .otherwise(F.lit(None))
    )
    return table(spark, folder, "conversations").select(
        message_id().alias("prompt_id"), F.col("text").alias("prompt"), raw.alias("raw_response")
    )


def page_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """A prompt per page whose reply names that page and one that is not stored."""
    stored = F.struct(
        F.col("url"), F.concat(F.lit("Page "), _text("page_id")).alias("source_name")
    )
    missing = F.struct(
        F.concat(F.lit("https://missing.example.org/"), _text("page_id")).alias("url"),
        F.lit("Missing").alias("source_name"),
    )
    reply = F.to_json(F.struct(F.array(missing, stored).alias("urls")))
    return pages(spark, folder).select(
        F.col("page_id").alias("prompt_id"), F.col("url").alias("prompt"), reply.alias("raw_response")
    )


def fetch_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Four attempts per URL, their outcome given by the kind of event."""
    kind = F.col("event_type")
    status = F.when(kind == "click", 200).when(kind == "view", 500).when(kind == "purchase", 404)
    status = status.when(kind == "signup", 302)
    return table(spark, folder, "events").select(
        F.concat(
            F.lit("https://log.example.org/"), F.expr("event_id div 4").cast("string")
        ).alias("url"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt"),
        status.alias("status"),
        F.when(kind == "error", "timeout").alias("error"),
        F.when(status < 400, F.col("props")).alias("body"),
    )
