"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import (
    clean_text, content_hash, display_trunc, has_skip_class, join_tags,
)
from leafmill.functions.urls import netloc, url_join
from leafmill.operators import dom
from leafmill.operators.dedup import append_merge, dedup_content, dedup_full, dedup_removed
from leafmill.operators.extract import DOC, extract, extract_all, extract_errors, with_document
from leafmill.operators.profile import (
    api_sample, cli_more, cli_sample, column_order, page_counts, summary_by_source,
    summary_by_type, summary_sample, summary_totals,
)
from leafmill.plans import routing
from leafmill.plans.replies import empty_plans, plan_summary, plan_urls, plans
from leafmill.run import run_report
from leafmill.session import new_folder, prepare, store
from leafmill.sources.csv import (
    BOM, column_names, drop_type, file_profile, output_path, read_csv, save_csv, save_snapshot, snapshots, widen,
)
from leafmill.sources.pages import extract_planned, planned_pages, resolve_fetches
from leafmill.sources.table import RowTable
from registry import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROW = ["page_id", "pos", "source", "type", "text", "href"]


def query(build: Query) -> Query:
    """Register a function under its name; a closing underscore only avoids a clash."""

    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return build(prepare(spark), folder)

    QUERIES[build.__name__.rstrip("_")] = prepared
    return build


def _rows(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*ROW, *more).withColumn("pos", F.col("pos").cast("bigint"))


# Plans ---------------------------------------------------------------------


@query
def plan_route(spark, folder):
    return routing.route(derived.document_prompts(spark, folder)).select("prompt_id", "rule")


def _targets(prompts: DataFrame, targets: Column) -> DataFrame:
    exploded = prompts.select("prompt_id", F.posexplode(targets).alias("at", "target"))
    return exploded.select(
        "prompt_id", (F.col("at") + 1).cast("bigint").alias("pos"), "target.url",
        "target.source_name", "target.description",
        F.array_join("target.expected_elements", ",").alias("expected"),
    )


@query
def plan_pages(spark, folder):
    """The pages of both paged rules for every message."""
    both = F.concat(routing.paged_targets("books"), routing.paged_targets("quotes"))
    return _targets(derived.message_prompts(spark, folder), both)


@query
def plan_urls_(spark, folder):
    routed = routing.route(derived.document_prompts(spark, folder))
    return _targets(routed, routing.targets(F.col("prompt"), F.col("rule")))


@query
def plan_topic(spark, folder):
    prompts = derived.message_prompts(spark, folder)
    return prompts.select("prompt_id", routing.topic(F.col("prompt")).alias("topic"))


@query
def plan_header(spark, folder):
    planned = plans(derived.message_prompts(spark, folder))
    return planned.select(
        "prompt_id", "plan.project_description", "plan.data_type", "plan.scraping_strategy",
        F.col("plan.estimated_rows").try_cast("bigint").alias("estimated_rows"),
        F.array_join("plan.target_columns", ",").alias("target_columns"),
        F.when(F.col("plan.urls").isNotNull(), F.size("plan.urls")).cast("bigint").alias("url_count"),
    )


@query
def plan_parse(spark, folder):
    planned = plans(derived.replies(spark, folder))
    return planned.select(
        "prompt_id", "planned_by", "plan.project_description", "plan.data_type",
        F.when(F.col("plan.urls").isNotNull(), F.size("plan.urls")).cast("bigint").alias("url_count"),
    )


@query
def plan_summary_(spark, folder):
    return plan_summary(plans(derived.replies(spark, folder)))


@query
def plan_explode(spark, folder):
    return plan_urls(plans(derived.replies(spark, folder))).drop("expected_elements")


@query
def plan_empty(spark, folder):
    return empty_plans(plans(derived.replies(spark, folder)))


@query
def catalog(spark, folder):
    """How many planned URLs the host of each catalogue entry gets."""
    planned = plan_urls(plans(derived.document_prompts(spark, folder)))
    by_host = planned.groupBy(netloc(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("planned_urls")
    )
    entries = routing.catalog(spark).withColumn("host", netloc(F.col("url_template")))
    return entries.join(by_host, "host", "left").select(
        "category", "url_template", "description",
        F.coalesce("planned_urls", F.lit(0)).alias("planned_urls"),
    )


@query
def page_category(spark, folder):
    """The category of each planned URL by its host."""
    planned = plan_urls(plans(derived.document_prompts(spark, folder)))
    return routing.page_categories(planned.select("prompt_id", "pos", "url"))


# Sources -------------------------------------------------------------------


@query
def scan_pages(spark, folder):
    planned = plan_urls(plans(derived.page_prompts(spark, folder)))
    found = planned_pages(planned, derived.pages(spark, folder))
    return found.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query
def fetch_resolve(spark, folder):
    found = resolve_fetches(derived.fetch_attempts(spark, folder))
    return found.withColumn("attempt", F.col("attempt").cast("bigint"))


@query
def scan_csv(spark, folder):
    rows = extract(derived.meta_pages(spark, folder), ["metadata"])
    path = save_csv(rows, new_folder(spark, "scan"), json_cells=False)
    return read_csv(spark, path, ["source", "type", "text", "href"])


# Functions -----------------------------------------------------------------


@query
def clean_text_(spark, folder):
    documents = derived.table(spark, folder, "documents")
    return documents.select("doc_id", clean_text(F.col("text")).alias("text"))


@query
def netloc_(spark, folder):
    return derived.pages(spark, folder).select("page_id", netloc(F.col("url")).alias("netloc"))


@query
def url_join_(spark, folder):
    """Every page address with absolute, rooted, relative and query references."""
    refs = ["", "/a/b", "x/../y", "?q=1", "#top", "//other.example/z", "mailto:a@b", "HTTP://h/"]
    pages = derived.pages(spark, folder).select(
        "page_id", "url", F.explode(F.array(*[F.lit(r) for r in refs])).alias("href")
    )
    return pages.select("page_id", "href", url_join(F.col("url"), F.col("href")).alias("joined"))


@query
def content_hash_(spark, folder):
    key = content_hash(F.col("text"), F.nullif(F.col("lang"), F.lit("en")), F.col("source"))
    return derived.table(spark, folder, "documents").select("doc_id", key.alias("content_key"))


@query
def display_trunc_(spark, folder):
    return derived.table(spark, folder, "documents").select(
        "doc_id",
        display_trunc(F.col("text"), 80, "nan").alias("text_80"),
        display_trunc(F.col("text"), 100).alias("text_100"),
        display_trunc(F.col("source"), 2).alias("source_2"),
    )


@query
def join_tags_(spark, folder):
    rows = extract(derived.quote_pages(spark, folder), ["quotes"])
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "tags")


@query
def has_skip_class_(spark, folder):
    """Whether the words of a text, taken as a class list, mark navigation."""
    skip = has_skip_class(F.split("text", "\\s+"))
    return derived.table(spark, folder, "documents").select("doc_id", skip.alias("skip"))


# Extractors ----------------------------------------------------------------


@query
def extract_tables(spark, folder):
    rows = extract(derived.table_pages(spark, folder), ["tables"])
    return rows.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "source", "type", "text", "price",
        F.col("table_index").cast("bigint").alias("table_index"),
        F.explode("cells").alias("name", "value"),
    )


@query
def extract_tables_nested(spark, folder):
    """Thirteen tables a page, of which ten count, the third inside the second."""
    rows = extract(derived.many_table_pages(spark, folder), ["tables"])
    return rows.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("table_index").cast("bigint").alias("table_index"),
        F.explode("cells").alias("name", "value"),
    )


@query
def extract_lists(spark, folder):
    return _rows(extract(derived.pages(spark, folder), ["lists"]))


@query
def extract_lists_nested(spark, folder):
    return _rows(extract(derived.outline_pages(spark, folder), ["lists"]))


@query
def extract_paragraphs(spark, folder):
    return _rows(extract(derived.pages(spark, folder), ["paragraphs"]))


@query
def extract_headings(spark, folder):
    return _rows(extract(derived.pages(spark, folder), ["headings"]))


@query
def extract_headings_by_level(spark, folder):
    return _rows(extract(derived.outline_pages(spark, folder), ["headings"]))


@query
def extract_links(spark, folder):
    return _rows(extract(derived.pages(spark, folder), ["links"]))


@query
def extract_title(spark, folder):
    rows = extract(derived.pages(spark, folder), ["metadata"])
    return _rows(rows.filter(F.col("type") == "page_title"))


@query
def extract_meta(spark, folder):
    return _rows(extract(derived.meta_pages(spark, folder), ["metadata"]))


@query
def extract_quotes(spark, folder):
    return _rows(extract(derived.quote_pages(spark, folder), ["quotes"]), "author", "tags")


@query
def extract_books(spark, folder):
    return _rows(extract(derived.book_pages(spark, folder), ["books"]), "price", "rating")


@query
def extract_jobs(spark, folder):
    rows = extract(derived.job_pages(spark, folder), ["jobs"])
    return _rows(rows, "company", "location", "posted")


@query
def extract_products(spark, folder):
    rows = extract(derived.product_pages(spark, folder), ["products"])
    return _rows(rows, "price", "description", "rating")


@query
def extract_news(spark, folder):
    return _rows(extract(derived.news_pages(spark, folder), ["news"]), "score", "age")


@query
def extract_page(spark, folder):
    """All families of the book pages: several families meet on one page."""
    return _rows(extract_all(derived.book_pages(spark, folder)), "price", "rating")


@query
def extract_all_(spark, folder):
    return _rows(extract_all(derived.pages(spark, folder)))


@query
def extract_planned_pages(spark, folder):
    planned = store(plan_urls(plans(derived.page_prompts(spark, folder))), "plan-urls")
    rows = extract_planned(planned, derived.pages(spark, folder))
    return rows.select(
        "prompt_id", F.col("page_ord").cast("bigint").alias("page_ord"),
        F.col("pos").cast("bigint").alias("pos"), "source", "type", "text", "href",
    )


@query
def extract_planned_recrawled(spark, folder):
    """Every page is stored twice; the earlier version says nothing of what the plans get."""
    planned = store(plan_urls(plans(derived.page_prompts(spark, folder))), "plan-urls")
    pages = derived.pages(spark, folder)
    earlier = pages.select(
        (-1 - F.col("page_id")).alias("page_id"), "url", F.lit("<h1>old title</h1>").alias("html")
    )
    rows = extract_planned(planned, pages.union(earlier))
    return rows.select(
        "prompt_id", F.col("page_ord").cast("bigint").alias("page_ord"),
        F.col("pos").cast("bigint").alias("pos"), "source", "type", "text", "href",
    )


@query
def extract_link_errors(spark, folder):
    """Addresses that cannot be resolved: every page gets one beside its own links."""
    broken = F.concat(F.col("html"), F.lit('<a href="http//[x">ok</a><a href="//[x">bad</a>'))
    pages = derived.pages(spark, folder).withColumn("html", broken)
    return extract_errors(pages).select("page_id", "href", "reason")


# Questions to a document ---------------------------------------------------


def _documents(pages: DataFrame, keep_all: bool = False) -> tuple[DataFrame, Column]:
    return with_document(pages, keep_all), F.col(DOC)


@query
def dom_find_all(spark, folder):
    documents, doc = _documents(derived.pages(spark, folder), keep_all=True)
    tags = ["p", "li", "a", "b", "br", "nav", "article", "footer", "body"]
    counts = [F.size(dom.find_all(doc["nodes"], dom.is_tag(t))).cast("bigint") for t in tags]
    return documents.select("page_id", *[c.alias(f"n_{t}") for t, c in zip(tags, counts)])


@query
def dom_class(spark, folder):
    documents, doc = _documents(derived.pages(spark, folder))
    ad = dom.first(doc["nodes"], dom.is_tag("div", cls="ad"))
    return documents.select("page_id", dom.text(doc, ad).alias("text"))


@query
def dom_class_part(spark, folder):
    documents, doc = _documents(derived.book_pages(spark, folder))
    rated = dom.find_all(doc["nodes"], lambda n: dom.class_contains(n, "star-rat"))
    classes = F.transform(rated, lambda n: F.array_join(n["classes"], " "))
    return documents.select("page_id", F.explode(classes).alias("classes"))


@query
def dom_first(spark, folder):
    documents, doc = _documents(derived.pages(spark, folder), keep_all=True)
    nav = dom.first(doc["nodes"], dom.is_tag("nav"))
    link = dom.first(dom.subtree(doc, nav), dom.is_tag("a"))
    return documents.select("page_id", link["href"].alias("href"), dom.text(doc, link).alias("text"))


@query
def dom_children(spark, folder):
    """Children and descendants of the list of a page."""
    documents, doc = _documents(derived.outline_pages(spark, folder))
    outer = dom.first(doc["nodes"], dom.is_tag("ol"))
    entries = dom.find_all(dom.subtree(doc, outer), dom.is_tag("li"))
    return documents.select(
        "page_id",
        F.size(dom.children(doc, outer)).cast("bigint").alias("n_children"),
        F.size(entries).cast("bigint").alias("n_items"),
    )


@query
def dom_parent(spark, folder):
    documents, doc = _documents(derived.outline_pages(spark, folder))
    last = F.try_element_at(dom.find_all(doc["nodes"], dom.is_tag("ul")), F.lit(-1))
    holder = dom.parent(doc, last)
    return documents.select("page_id", F.array_join(holder["classes"], " ").alias("classes"))


@query
def dom_next_row(spark, folder):
    documents, doc = _documents(derived.news_pages(spark, folder))
    stories = dom.find_all(doc["nodes"], dom.is_tag("tr", cls="athing"))
    below = F.transform(stories, lambda n: dom.raw_text(doc, dom.next_row(doc, n)))
    return documents.select("page_id", F.posexplode(below).alias("at", "text")).select(
        "page_id", F.col("at").cast("bigint").alias("pos"), "text"
    )


@query
def dom_attribute(spark, folder):
    documents, doc = _documents(derived.pages(spark, folder))
    linked = dom.find_all(doc["nodes"], lambda n: n["href"].isNotNull())
    named = dom.find_all(doc["nodes"], lambda n: (n["tag"] == "meta") & (dom.or_empty(n["name"]) == ""))
    return documents.select(
        "page_id",
        F.array_join(F.transform(linked, lambda n: n["href"]), " ").alias("hrefs"),
        F.size(named).cast("bigint").alias("unnamed_meta"),
    )


@query
def dom_text(spark, folder):
    """The text of the body: comments, scripts and styles do not count."""
    documents, doc = _documents(derived.pages(spark, folder), keep_all=True)
    body = dom.first(doc["nodes"], dom.is_tag("body"))
    return documents.select("page_id", dom.raw_text(doc, body).alias("text"))


@query
def dom_stripped_text(spark, folder):
    documents, doc = _documents(derived.quote_pages(spark, folder))
    tags = dom.find_all(doc["nodes"], dom.is_tag("a", cls="tag"))
    texts = F.transform(tags, lambda n: dom.stripped_text(doc, n))
    return documents.select("page_id", join_tags(texts).alias("tags"))


@query
def dom_first_k(spark, folder):
    documents, doc = _documents(derived.pages(spark, folder))
    first = F.slice(dom.find_all(doc["nodes"], dom.is_tag("p")), 1, 10)
    return documents.select("page_id", F.size(first).cast("bigint").alias("n_first"))


@query
def dom_count(spark, folder):
    documents, doc = _documents(derived.product_pages(spark, folder))
    stars = dom.find_all(doc["nodes"], dom.is_tag("span", cls="ws-icon-star"))
    return documents.select("page_id", F.size(stars).cast("bigint").alias("n_stars"))


# Duplicates ----------------------------------------------------------------


def _document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as rows of one type: they hold exact copies."""
    return derived.table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_ord"), F.lit(0).alias("pos"), "text", "lang",
        F.lit("document").alias("type"), F.nullif(F.col("lang"), F.lit("en")).alias("source"),
    )


@query
def dedup_content_of_documents(spark, folder):
    kept = dedup_content(_document_rows(spark, folder))
    return kept.select(F.col("page_ord").alias("doc_id"), "source", F.md5("text").alias("text_md5"))


@query
def dedup_content_(spark, folder):
    """Rows of all pages under one source name, so that copies meet."""
    named = derived.pages(spark, folder).withColumn("source_name", F.lit("all"))
    return _rows(dedup_content(extract_all(named)))


@query
def dedup_content_of_tables(spark, folder):
    """Table rows have no text: those of one source become one row."""
    rows = dedup_content(extract(derived.table_pages(spark, folder), ["tables"]))
    return rows.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "source", "type", "text", "price"
    )


@query
def dedup_full_(spark, folder):
    """Table rows that agree in all fields and cells become one."""
    rows = dedup_full(extract(derived.table_pages(spark, folder), ["tables"]))
    return rows.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "source", "type", "text", "price"
    )


@query
def dedup_removed_(spark, folder):
    named = derived.pages(spark, folder).withColumn("source_name", F.lit("all"))
    return dedup_removed(extract_all(named))


@query
def append_merge_(spark, folder):
    """Saved headings and paragraphs, then all rows."""
    pages = derived.pages(spark, folder)
    path = save_csv(extract(pages, ["headings", "paragraphs"]), new_folder(spark, "existing"), json_cells=False)
    saved = read_csv(spark, path, ["source", "type", "text", "href"])
    return append_merge(saved, extract_all(pages)).select("source", "type", "text", "href")


@query
def dedup_links(spark, folder):
    """Every page holds its links twice."""
    twice = F.concat("html", "html")
    pages = derived.pages(spark, folder).withColumn("html", twice)
    return _rows(extract(pages, ["links"]))


# Profiles ------------------------------------------------------------------


@query
def summary_totals_(spark, folder):
    return summary_totals(extract_all(derived.pages(spark, folder)))


@query
def summary_columns_of_tables(spark, folder):
    order = column_order(extract_all(derived.table_pages(spark, folder)))
    return order.select("name", F.col("first_met.at").cast("bigint").alias("field_at"))


@query
def summary_by_source_(spark, folder):
    return summary_by_source(extract_all(derived.pages(spark, folder)))


@query
def summary_by_type_(spark, folder):
    return summary_by_type(extract_all(derived.pages(spark, folder)))


@query
def page_counts_(spark, folder):
    return page_counts(derived.pages(spark, folder))


@query
def summary_sample_(spark, folder):
    return summary_sample(extract_all(derived.pages(spark, folder)))


@query
def summary_sample_of_tables(spark, folder):
    return summary_sample(extract(derived.table_pages(spark, folder), ["tables"]))


@query
def cli_sample_(spark, folder):
    return cli_sample(extract_all(derived.pages(spark, folder)))


@query
def cli_more_(spark, folder):
    return cli_more(extract_all(derived.pages(spark, folder)))


@query
def api_sample_(spark, folder):
    return _rows(api_sample(extract_all(derived.pages(spark, folder))))


@query
def file_profile_(spark, folder):
    path = save_csv(extract_all(derived.pages(spark, folder)), new_folder(spark, "profile"), json_cells=False)
    header = len(BOM.encode()) + len("source,type,text,href\n")
    return file_profile(spark, path).select(
        "n_rows", "n_columns", (F.col("n_bytes") - F.col("n_files") * header).alias("row_bytes")
    )


@query
def run_report_(spark, folder):
    planned = store(plans(derived.page_prompts(spark, folder)), "plans")
    rows = extract_planned(plan_urls(planned), derived.pages(spark, folder))
    return run_report(planned, rows, "output.csv")


# Sinks ---------------------------------------------------------------------


@query
def sink_csv(spark, folder):
    path = save_csv(extract_all(derived.pages(spark, folder)), new_folder(spark, "output"), json_cells=False)
    return read_csv(spark, path)


@query
def sink_path(spark, folder):
    """Rows saved under a relative name, which lies in the output folder."""
    output = new_folder(spark, "outputs")
    rows = extract(derived.pages(spark, folder), ["headings"])
    save_csv(rows, output_path(output, "headings.csv"), json_cells=False)
    return read_csv(spark, f"{output}/headings.csv").select("source", "type", "text", "href")


@query
def sink_snapshot(spark, folder):
    """Two snapshots; the rows that both runs of the table hold."""
    rows, output = extract_all(derived.book_pages(spark, folder)), new_folder(spark, "snapshots")
    for day in (1, 2):
        save_snapshot(rows, output, now=datetime.datetime(2024, 1, day))
    return snapshots(spark, output).read().select(
        "run_ts", "source", "type", "text", "price", "rating", "href"
    )


@query
def sink_append(spark, folder):
    """Headings and paragraphs in a table of rows, then all rows: what each run added."""
    pages, table = derived.pages(spark, folder), RowTable(spark, new_folder(spark, "table"), digits=1)
    table.append(extract(pages, ["headings", "paragraphs"]), "first")
    table.append(extract_all(pages), "second")
    table.append(extract_all(pages), "third")
    return table.read().select("run_ts", "source", "type", "text", "href")


@query
def sink_replaced(spark, folder):
    """A run saved again holds the new rows only, with its columns known from the catalogue."""
    rows, table = extract(derived.table_pages(spark, folder), ["tables"]), RowTable(spark, new_folder(spark, "table"))
    table.save(extract_all(derived.table_pages(spark, folder)), "run")
    table.save(rows, "run", full=True)
    names = table.columns()
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    cells = table.read().select(F.explode(F.map_keys("cells")).alias("name"))
    return cells.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("column_at", order)


@query
def drop_type_(spark, folder):
    rows = extract(derived.job_pages(spark, folder), ["jobs"])
    path = save_csv(rows, new_folder(spark, "saved"), json_cells=False)
    return drop_type(read_csv(spark, path))


@query
def widen_(spark, folder):
    rows = store(extract(derived.table_pages(spark, folder), ["tables"]), "table-rows")
    wide = widen(rows, column_names(rows))
    return wide.withColumn("page_ord", F.col("page_ord").cast("bigint")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )
