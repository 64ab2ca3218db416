"""Time the headline queries: prints one JSON line.

`BENCH_SF_DIR` names the tables (default sf0.1), `BENCH_CPUS` the cores.  Every
query runs twice and the second run counts, so that neither the start of the
Python workers nor the JVM's warm-up is timed.  Results go to Spark's noop sink:
the whole result is computed, nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.extract import with_document
from leafmill.session import prepare
from registry import derived
from registry.queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "clean_text",
    "plan_route",
    "plan_urls",
    "plan_explode",
    "fetch_resolve",
    "extract_paragraphs",
    "extract_links",
    "extract_tables",
    "extract_quotes",
    "extract_books",
    "extract_news",
    "extract_all",
    "extract_planned_pages",
    "dedup_content_of_documents",
    "dedup_content",
    "append_merge",
    "page_counts",
    "summary_totals",
    "summary_by_type",
    "run_report",
    "sink_csv",
]


def shred_only(spark: SparkSession, folder: str) -> DataFrame:
    return with_document(derived.pages(spark, folder))


def seconds(spark: SparkSession, build) -> float:
    best = 0.0
    for _ in range(2):
        start = time.perf_counter()
        build(spark, FOLDER).write.format("noop").mode("overwrite").save()
        best = time.perf_counter() - start
    return round(best, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CORES}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CORES)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    times = {"shred": seconds(spark, shred_only)}
    times |= {name: seconds(spark, QUERIES[name]) for name in HEADLINES}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    size = pages.agg(F.count(F.lit(1)), F.sum(F.length("html"))).first()
    rows = QUERIES["extract_all"](spark, FOLDER).count()
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
        "pages_per_sec": round(size[0] / times["extract_all"], 1),
        "mchars_per_sec": round(size[1] / times["extract_all"] / 1e6, 2),
        "rows_per_sec": round(rows / times["extract_all"], 1),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
