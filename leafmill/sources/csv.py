"""Saving rows as CSV and reading them back."""

from __future__ import annotations

import datetime
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators.dedup import dedup_content, dedup_full, merge_unique
from leafmill.operators.profile import row_shapes, shape_columns
from leafmill.schema import FAMILIES, FIELDS, ORDER
from leafmill.session import exact_names, store
from leafmill.sources import files
from leafmill.sources.table import RowTable

# Fixed value: the byte order mark a saved file starts with.
BOM = "\N{ZERO WIDTH NO-BREAK SPACE}"
MAX_COLUMNS = 10_000
_CSV = {
    "header": True,
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def column_names(rows: DataFrame, max_columns: int = MAX_COLUMNS) -> list[str]:
    """The columns of the wide table, in the order they are first met.

    The list is the schema of the result, so it must reach the driver; more
    than ``max_columns`` names is an error, not a cut.
    """
    return named_columns(row_shapes(rows), max_columns)


def named_columns(shapes: DataFrame, max_columns: int = MAX_COLUMNS) -> list[str]:
    """`column_names` of rows with these shapes."""
    names = shape_columns(shapes).orderBy("first_met").limit(max_columns + 1).select("name").collect()
    if len(names) > max_columns:
        raise ValueError(f"more than {max_columns} columns; keep the cells as a map")
    return [row["name"] for row in names]


def widen(
    rows: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ORDER
) -> DataFrame:
    """The wide table: one column per field name met, absent values NULL.

    The columns to ``keep``, by default those that order the rows, stand in front.
    A table header that is named like one of them, in any case of letters, gets
    the ending ``_cell``.
    """
    names = column_names(rows) if columns is None else list(columns)
    shown = _apart(names, keep)

    def value(name: str) -> Column:
        if name == "table_index":
            return F.coalesce(F.try_element_at("cells", F.lit(name)), F.col(name).cast("string"))
        return F.col(name) if name in FIELDS else F.try_element_at("cells", F.lit(name))

    return rows.select(*keep, *[value(name).alias(shown[name]) for name in names])


def _apart(names: Sequence[str], keep: Sequence[str]) -> dict[str, str]:
    """How columns are called so that none is taken for a kept one."""
    shown, taken = {}, {k.lower() for k in keep}
    for name in names:
        new = name
        while new.lower() in taken or (new != name and new in names):
            new += "_cell"
        shown[name] = new
    return shown


def with_json_cells(rows: DataFrame, keep: Sequence[str] = ORDER) -> DataFrame:
    """The fields of each row, with all table cells as one JSON text.

    For crawls whose tables have too many different headers for columns.
    """
    return rows.select(*keep, *FIELDS, F.to_json("cells").alias("cells"))


def _as_saved(rows: DataFrame, columns: Sequence[str] | None, scope: Sequence[str], json_cells: bool) -> DataFrame | None:
    """The table a file holds, None when there are no rows; one aggregation answers all that must be known first.

    Table numbers that share a numeric column with rows that have none are
    floating-point numbers there, so 0 is written as 0.0.
    """
    if json_cells:
        return None if rows.isEmpty() else with_json_cells(rows, scope)
    is_table = F.col("family_rank") == FAMILIES["tables"]
    replaced = F.coalesce(F.map_contains_key("cells", F.lit("table_index")), F.lit(False))
    shapes = row_shapes(rows, F.bool_or(~is_table).alias("others"), F.bool_or(replaced).alias("texts"))
    shapes = store(shapes, "row-shapes")
    n, mixed = shapes.agg(F.count(F.lit(1)), F.bool_or("others") & ~F.bool_or("texts")).first()
    if n == 0:
        return None
    wide = widen(rows, named_columns(shapes) if columns is None else columns, scope)
    if "table_index" in wide.columns and mixed:
        wide = wide.withColumn("table_index", F.col("table_index").cast("double").cast("string"))
    return wide


def save_csv(
    rows: DataFrame,
    path: str,
    append: bool = False,
    columns: Sequence[str] | None = None,
    scope: Sequence[str] = (),
    json_cells: bool = True,
    full: bool = False,
) -> str:
    """Deduplicate rows and save them as a folder of CSV parts; the path, or ''.

    Every part has a header and starts with a byte order mark.  No rows: nothing
    is written and '' is returned.  The rows are written once to the shared
    folder first, as the column names need a pass of their own.  Table cells
    stay together in one column of JSON; ``json_cells=False`` gives each header a
    column, which is an error above ``MAX_COLUMNS``.  With ``full`` rows are
    equal only if all fields are, so that every table row is kept; appending
    still compares text, type and source.

    A new file is written beside an older one, which goes only when the new one
    is complete.  Appending writes all rows again; a `RowTable` does not.
    """
    unique = store((dedup_full if full else dedup_content)(rows, scope), "unique-rows")
    return write_csv(unique, path, append, columns, scope, json_cells)


def write_csv(
    unique: DataFrame,
    path: str,
    append: bool = False,
    columns: Sequence[str] | None = None,
    scope: Sequence[str] = (),
    json_cells: bool = True,
) -> str:
    """`save_csv` for stored rows without copies, e.g. those of a `RowTable`."""
    spark = unique.sparkSession
    unique = unique.withColumns({name: F.col(name).cast("string") for name in scope})
    with exact_names(spark):
        table = _as_saved(unique, columns, scope, json_cells)
        if table is None:
            return ""
        files.recover(spark, path)
        if append and files.exists(spark, path):
            table = merge_unique(read_csv(spark, path), _identified(table), scope=scope)
        new = f"{path}.next"
        _write(table, new)
    files.replace(spark, new, path)
    return path


def _identified(wide: DataFrame) -> DataFrame:
    """A wide table with the three key columns, whatever families it holds."""
    for name in ("source", "type", "text"):
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit(None).cast("string"))
    return wide


def _write(wide: DataFrame, path: str) -> None:
    first, *rest = wide.columns
    marked = wide.toDF(BOM + first, *rest)
    marked.write.mode("overwrite").options(**_CSV, emptyValue="").csv(path)


def snapshot_path(folder: str, prefix: str = "crawl", now: datetime.datetime | None = None) -> str:
    """`{prefix}_{yyyymmdd_HHMMSS}` inside the folder."""
    now = now or datetime.datetime.now()
    return os.path.join(folder, f"{prefix}_{run_name(now)}.csv")


def run_name(now: datetime.datetime) -> str:
    return f"{now:%Y%m%d_%H%M%S}"


def save_snapshot(
    rows: DataFrame, folder: str, prefix: str = "crawl", now: datetime.datetime | None = None,
    scope: Sequence[str] = (), full: bool = False, **options,
) -> str:
    """Save the rows as a run of the folder's table of snapshots and under a name that carries the time.

    The rows are made once, for the table; the CSV file is written from there.
    """
    now = now or datetime.datetime.now()
    path = snapshot_path(folder, prefix, now)
    table, run = snapshots(rows.sparkSession, folder, prefix), run_name(now)
    table.save(rows, run, scope, full)
    return write_csv(table.read(run), path, scope=scope, **options)


def snapshots(spark: SparkSession, folder: str, prefix: str = "crawl") -> RowTable:
    """The table of all snapshots of a folder: its rows have the time of their run, ``run_ts``."""
    return RowTable(spark, os.path.join(folder, f"{prefix}_rows"))


def output_path(folder: str, name: str) -> str:
    """A relative name lies in the output folder; an absolute one is kept."""
    return name if os.path.isabs(name) or "://" in name else os.path.join(folder, name)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Saved rows, every column text; empty cells are NULL.

    Without ``columns`` the names are read from the header of a file.  To query
    a file with names that differ in case only, use `session.exact_names`.
    """
    reader = spark.read.options(**_CSV, multiLine=True)
    if columns is not None:
        return reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)
    with exact_names(spark):
        return reader.csv(path)


def drop_type(saved: DataFrame) -> DataFrame:
    return saved.drop("type")


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows, columns, bytes and files of a saved table: one row."""
    saved = read_csv(spark, path)
    n_columns = len(saved.columns)
    # Lengths come from the listing; parts that hold only a header count too.
    parts = spark.read.format("binaryFile").load(path).select("length")
    return saved.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(n_columns).cast("bigint").alias("n_columns"),
        F.coalesce(parts.agg(F.sum("length")).scalar(), F.lit(0)).alias("n_bytes"),
        parts.agg(F.count(F.lit(1))).scalar().alias("n_files"),
    )
