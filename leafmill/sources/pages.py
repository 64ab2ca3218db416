"""Where pages come from: stored tables, plans and fetch logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.bloom import bloom_filter, n_blocks, possible
from leafmill.operators.extract import default_source, extract
from leafmill.session import store

MAX_ATTEMPTS = 3
NOT_FOUND = 404
_HTTP_ERRORS_FROM = 400
MOST_HOT = 100_000
HOT_ROWS = 10_000
# Keys that may be sent to every task as a list, some 10 MB of addresses.
MOST_LISTED = 100_000


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The stored pages that hold any markup; only the needed columns are read."""
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return pages.filter(F.col("html") != "")


def resolve_fetches(attempts: DataFrame, max_attempts: int | None = MAX_ATTEMPTS) -> DataFrame:
    """One page per URL from a log `(url, attempt, status, error, body)`.

    Of the first ``max_attempts`` (None: all) the first that ends the URL counts: a success
    gives the page, a 404 gives none.  Other errors only lead to the next
    attempt.  Failed attempts are dropped before anything is shuffled.
    """
    status = F.col("status")
    succeeded = status < _HTTP_ERRORS_FROM
    if max_attempts is not None:
        attempts = attempts.filter(F.col("attempt") <= max_attempts)
    ending = attempts.filter(
        F.col("error").isNull()
        & (succeeded | (status == NOT_FOUND))
    ).select("url", "attempt", "status", F.when(succeeded, F.col("body")).alias("html"))
    first = Window.partitionBy("url").orderBy("attempt", "status", "html")
    return (
        ending.withColumn("_rank", F.row_number().over(first))
        .filter((F.col("_rank") == 1) & (F.col("status") != NOT_FOUND))
        .select("url", "attempt", "html")
    )


def _only(rows: DataFrame, columns: Sequence[str], keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows with one of so many keys (NULL equals NULL), cut where they are read.

    Up to ``MOST_LISTED`` keys are broadcast; more make a Bloom filter, which
    lets a few other rows through.
    """
    if n_keys > MOST_LISTED:
        blocks = n_blocks(n_keys)
        return possible(rows, columns, bloom_filter(keys, columns, blocks), blocks)
    listed = F.broadcast(keys.select(*[F.col(c).alias(f"_key_{c}") for c in columns]).distinct())
    same = F.lit(True)
    for name in columns:
        same = same & rows[name].eqNullSafe(listed[f"_key_{name}"])
    return rows.join(listed, same, "left_semi")


def _winners(urls: DataFrame, n_urls: int, pages: DataFrame, version: str) -> DataFrame:
    """`(url, page_id, version, _copies)`: of each planned URL the latest stored page, told without its markup.

    The largest ``version`` wins, then the largest ``page_id``; NULL loses.
    ``_copies`` counts page rows that agree in all three.
    """
    named = list(dict.fromkeys(["url", version, "page_id"]))
    narrow = _only(pages.select(*named).filter(F.col("url").isNotNull()), ["url"], urls, n_urls)
    known = narrow.groupBy(*named).agg(F.count(F.lit(1)).alias("_copies"))
    if n_urls > MOST_LISTED:
        known = known.join(urls.distinct(), "url", "left_semi")
    latest = F.max(F.struct(*named[1:], "_copies")).alias("latest")
    return known.groupBy("url").agg(latest).select("url", "latest.*")


class PlannedPages:
    """The pages that any plan asks for: of each URL the latest, by the ``version`` column.

    Which page wins is found on the URL, the version and the id alone, behind a
    list or Bloom filter of the planned URLs.  A second one, of the winners, then
    keeps the markup of other pages, also of older versions, from leaving the task
    that reads it, but for the few that pass a Bloom filter by chance.
    """

    def __init__(self, plan_urls: DataFrame, pages: DataFrame, version: str = "page_id"):
        urls = plan_urls.select("url")
        self.n_planned = urls.count()
        self.pages = pages
        self.named = list(dict.fromkeys(["url", version, "page_id"]))
        self.winners = store(_winners(urls, self.n_planned, pages, version), "planned-pages")
        found = self.winners.agg(F.count(F.lit(1)), F.max("_copies")).first()
        self.n_winners, self.copied = found[0], (found[1] or 0) > 1

    def likely(self) -> DataFrame:
        """All winners with their markup, and the few other pages that pass the filter."""
        return _only(self.pages, self.named, self.winners, self.n_winners)

    def exact(self) -> DataFrame:
        """The winners, one page each: of page rows that agree in URL, version and id the least markup."""
        pages, winners = self.likely().alias("p"), self.winners.alias("w")
        same = F.lit(True)
        for name in self.named:
            same = same & F.col(f"p.{name}").eqNullSafe(F.col(f"w.{name}"))
        columns = self.pages.columns
        found = pages.join(winners, same).select("p.*", "_copies")
        if not self.copied:
            return found.select(*columns)
        rest = F.struct(*[c for c in columns if c != "url"])
        one = found.filter("_copies > 1").groupBy("url").agg(F.min_by(rest, "html").alias("one"))
        return found.filter("_copies = 1").select(*columns).unionByName(one.select("url", "one.*"))


def planned_pages(plan_urls: DataFrame, pages: DataFrame, version: str = "page_id") -> DataFrame:
    """The pages that any plan asks for: of each URL the latest, by the ``version`` column.

    Without another column the largest ``page_id`` counts as the latest.
    """
    return PlannedPages(plan_urls, pages, version).exact()


def _hot_urls(plan_urls: DataFrame, rows_per_task: int) -> DataFrame:
    """`(name, _salts)` of the URLs that more planned rows share than one task does at once.

    These are URLs with ``rows_per_task`` rows or more, whatever their share of
    the plans, as long as they are fewer than ``MOST_HOT``: beyond that a task does
    as much as a ``MOST_HOT``-th of all rows.  A URL gets as many salts as it has
    times that number.  Its name is a hash, so the list is a few megabytes at most.
    """
    counts = plan_urls.groupBy(F.xxhash64("url").alias("_name")).agg(F.count(F.lit(1)).alias("n"))
    total = plan_urls.agg(F.count(F.lit(1))).scalar()
    each = F.greatest(F.lit(rows_per_task), F.ceil(total / MOST_HOT))
    return counts.filter(F.col("n") >= each).select("_name", F.ceil(F.col("n") / each).cast("int").alias("_salts"))


def extract_planned(
    plan_urls: DataFrame,
    pages: DataFrame,
    version: str = "page_id",
    rows_per_task: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """The rows of every plan: `prompt_id`, then the row with its plan's source.

    A page is shredded once however many plans name it, and where it is read: no
    markup is moved (unless ``partitions`` deals the pages out anew).  Only its rows
    are joined to the plans, and those of the few pages that passed the filter by
    chance fall out there.  Plans may well share a URL, so the plan rows of a hot
    URL are spread over salts, as many as its rows ask for (``rows_per_task``),
    and the rows of its page, which are few, are given to each of them.  The list
    of hot URLs is written once and broadcast.  ``plan_urls`` is read several
    times and should be stored.

    A header that replaced the source of a table row stays.
    """
    per_task = rows_per_task or HOT_ROWS
    wanted = PlannedPages(plan_urls, pages, version)
    name = F.xxhash64(*wanted.named).alias("_page")
    chosen = wanted.exact() if wanted.copied else wanted.likely()
    found = extract(chosen.withColumn("page_ord", name), partitions=partitions)
    rows = found.withColumnRenamed("page_ord", "_page")
    winners = wanted.winners.select("url", F.xxhash64(*wanted.named).alias("_winner"))
    if wanted.n_planned < per_task:
        salted = F.lit(0)
        plan = plan_urls.withColumn("_salt", salted)
        rows, winners = rows.withColumn("_salt", salted), winners.withColumn("_salt", salted)
    else:
        hot = F.broadcast(store(_hot_urls(plan_urls, per_task), "hot-urls"))

        def with_salts(frame: DataFrame) -> DataFrame:
            named = frame.withColumn("_name", F.xxhash64("url")).join(hot, "_name", "left")
            return named.withColumn("_salts", F.coalesce("_salts", F.lit(1))).drop("_name")

        def to_each(frame: DataFrame) -> DataFrame:
            salts = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
            return with_salts(frame).withColumn("_salt", salts).drop("_salts")

        own = F.pmod(F.xxhash64("prompt_id", "pos"), F.col("_salts")).cast("int")
        plan = with_salts(plan_urls).withColumn("_salt", own)
        rows, winners = to_each(rows), to_each(winners)
    plan = plan.select(
        "prompt_id", "url", F.col("pos").alias("page_ord"), F.col("source_name").alias("_name"), "_salt"
    )
    named = default_source(F.col("url"), F.col("_name"))
    replaced = F.map_contains_key("cells", F.lit("source"))
    source = F.when(replaced, F.col("source")).otherwise(named)
    asked = plan.join(winners, ["url", "_salt"])
    joined = asked.join(rows, ["url", "_salt"]).filter("_page = _winner")
    return joined.withColumn("source", source).drop("_name", "_salt", "_page", "_winner")
