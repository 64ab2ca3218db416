"""Duplicates: keep-first by content, and merging with earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import content_hash
from leafmill.schema import FIELDS, order_of

# Names no table header is likely to have.
_KEY = "_leafmill_key"
_RANK = "_leafmill_rank"
_NEW = "_leafmill_new"


def content_key() -> Column:
    return content_hash(F.col("text"), F.col("type"), F.col("source"))


def _keep_first(rows: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """The first row of each key.

    The filter on the rank lets Spark cut every key to one row per task before
    the shuffle, so a key that a third of all rows share moves one row a task.
    """
    ranked = rows.withColumn(_RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(_RANK) == 1).drop(_RANK)


def _told(value: Column) -> Column:
    """A value with its length, so that several in a row say where each ends; absent differs from ''."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def dedup_content(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The first row of equal (text, type, source), absent values counting as ''.

    ``scope`` names columns that separate independent runs, e.g. a prompt.
    """
    keyed = rows.withColumn(_KEY, content_key())
    return _keep_first(keyed, [*scope, _KEY], order_of(rows.columns)).drop(_KEY)


def dedup_full(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The first row of those that agree in every field and table cell.

    Unlike `dedup_content` this keeps different table rows of one source.
    """
    cells = F.to_json(F.sort_array(F.map_entries("cells")))
    fields = F.concat(*[_told(F.col(c)) for c in FIELDS if c in rows.columns], _told(cells))
    keyed = rows.withColumn(_KEY, F.md5(fields.cast("binary")))
    return _keep_first(keyed, [*scope, _KEY], order_of(rows.columns)).drop(_KEY)


def dedup_removed(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """How many rows `dedup_content` drops: one row, or one per scope value."""
    counts = rows.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_distinct(content_key()).alias("rows_out")
    )
    return counts.withColumn("removed", F.col("rows_in") - F.col("rows_out"))


def append_merge(
    existing: DataFrame,
    new: DataFrame,
    missing_equals_empty: bool = False,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Rows already saved, then new rows whose (text, type, source) is not among them.

    New rows are first deduplicated among themselves.  Re-read files hold NULL
    where '' was written, and NULL differs from '' unless
    ``missing_equals_empty``.  Rows without order columns are ordered by
    their fields.
    """
    return merge_unique(existing, dedup_content(new, scope), missing_equals_empty, scope)


def merge_unique(
    existing: DataFrame,
    unique: DataFrame,
    missing_equals_empty: bool = False,
    scope: Sequence[str] = (),
) -> DataFrame:
    """`append_merge` for new rows that hold no duplicates."""
    both = existing.withColumn(_NEW, F.lit(False)).unionByName(
        unique.withColumn(_NEW, F.lit(True)), allowMissingColumns=True
    )
    keys = [F.col(c) for c in ("text", "type", "source")]
    if missing_equals_empty:
        keys = [F.coalesce(k, F.lit("")) for k in keys]
    order = [_NEW, *order_of(both.columns), *[c for c in FIELDS if c in both.columns]]
    return _keep_first(both, [*scope, *keys], order).drop(_NEW)
