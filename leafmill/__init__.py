"""Web pages to typed rows on Spark: plan, shred, extract, deduplicate, save."""

from leafmill.operators.dedup import append_merge, dedup_content, dedup_removed
from leafmill.operators.extract import extract, extract_all, extract_errors
from leafmill.plans.replies import plan_urls, plans
from leafmill.run import Run, run
from leafmill.session import prepare
from leafmill.sources.csv import read_csv, save_csv, save_snapshot, widen
from leafmill.sources.pages import extract_planned, read_pages, resolve_fetches

__all__ = [
    "Run",
    "append_merge",
    "dedup_content",
    "dedup_removed",
    "extract",
    "extract_all",
    "extract_errors",
    "extract_planned",
    "plan_urls",
    "plans",
    "prepare",
    "read_csv",
    "read_pages",
    "resolve_fetches",
    "run",
    "save_csv",
    "save_snapshot",
    "widen",
]
