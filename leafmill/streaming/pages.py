"""Extraction on a stream of page files.

Extraction needs no state: `extract_all` works on a streaming table as it is.
Only keeping the first of equal rows looks at what was saved before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators.extract import extract_all
from leafmill.schema import PAGES
from leafmill.sources.table import RowTable


def page_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The page files of a folder, as they arrive."""
    return spark.readStream.schema(PAGES).options(**options).parquet(folder)


def stream_rows(
    pages: DataFrame, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Append every row of every page to a Parquet table."""
    writer = extract_all(pages).writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).format("parquet").start(path)


def stream_unique_rows(
    pages: DataFrame, path: str, checkpoint: str, digits: int = 2, **trigger
) -> StreamingQuery:
    """Append rows not saved by an earlier batch to a `RowTable`; the earlier row wins.

    Each batch is a run of the table.  It reads keys of the buckets its rows fall
    into, in folders whose number grows with the logarithm of the batches, and no
    saved row.  A batch that is run again after a failure finds its run and leaves it, or
    writes it whole.
    """

    def save(batch: DataFrame, number: int) -> None:
        RowTable(batch.sparkSession, path, digits).append(extract_all(batch), f"batch-{number:012d}")

    writer = pages.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
