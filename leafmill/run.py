"""Whole runs: prompts and stored pages to rows, files and reports."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.profile import api_sample, summary_by_source, summary_by_type
from leafmill.operators.profile import summary_sample, summary_totals
from leafmill.plans.replies import plan_urls, plans
from leafmill.session import drop_stored, prepare, store
from leafmill.sources.csv import output_path, run_name, save_csv, save_snapshot, snapshots, write_csv
from leafmill.sources.pages import extract_planned

# Rows of different prompts are never copies of each other.
SCOPE = ["prompt_id"]


@dataclass
class Run:
    """What a run leaves behind; `rows` are those before deduplication."""

    planned: DataFrame
    rows: DataFrame
    csv_path: str = ""
    snapshot_path: str = ""

    def close(self) -> None:
        """Delete the intermediate tables; the saved files stay.  Leaving a ``with`` block does so."""
        drop_stored(self.planned.sparkSession)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *exception: object) -> None:
        self.close()

    def report(self) -> DataFrame:
        return run_report(self.planned, self.rows, self.csv_path)

    def sample(self) -> DataFrame:
        return api_sample(self.rows)

    def summary(self) -> dict[str, DataFrame]:
        return {
            "totals": summary_totals(self.rows),
            "by_source": summary_by_source(self.rows),
            "by_type": summary_by_type(self.rows),
            "sample": summary_sample(self.rows),
        }


def run_report(planned: DataFrame, rows: DataFrame, csv_path: str = "") -> DataFrame:
    """Per prompt: rows before deduplication, planned URLs, and the file's path.

    A prompt whose plan is empty is an error, as is reported in its status.
    """
    counted = rows.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce("n", F.lit(0))
    sources = F.when(F.col("plan.urls").isNull(), 0).otherwise(F.size("plan.urls")).cast("bigint")
    return planned.join(counted, "prompt_id", "left").select(
        "prompt_id",
        F.when(sources > 0, "success").otherwise("error").alias("status"),
        total.alias("total_rows"),
        sources.alias("sources_scraped"),
        F.when(total > 0, csv_path).otherwise("").alias("csv_path"),
    )


def run(
    prompts: DataFrame,
    pages: DataFrame,
    folder: str | None = None,
    filename: str = "output.csv",
    snapshot: bool = True,
    full: bool = False,
    json_cells: bool = True,
) -> Run:
    """Plan the prompts, extract their pages, and save when a folder is given.

    ``full`` keeps rows that differ in any field, e.g. all rows of a table.
    Both files hold table cells as one JSON text, whatever the number of
    headers; ``json_cells=False`` saves the wide table, which is an error above
    ``MAX_COLUMNS`` names.

    The plans are joined twice and reported; the rows feed two files and the
    summary.  Both are written once to the shared checkpoint folder instead of
    being made again for each use; `Run.close` deletes them.
    """
    prepare(prompts.sparkSession)
    planned = store(plans(prompts), "plans")
    rows = extract_planned(plan_urls(planned), pages)
    rows = store(rows, "rows")
    if folder is None:
        return Run(planned, rows)
    path = output_path(folder, filename)
    if not snapshot:
        return Run(planned, rows, save_csv(rows, path, scope=SCOPE, full=full, json_cells=json_cells))
    # Both files and the run in the table of snapshots are of one deduplication.
    now = datetime.datetime.now()
    copy = save_snapshot(rows, folder, now=now, scope=SCOPE, full=full, json_cells=json_cells)
    saved = snapshots(prompts.sparkSession, folder).read(run_name(now))
    return Run(planned, rows, write_csv(saved, path, scope=SCOPE, json_cells=json_cells), copy)
