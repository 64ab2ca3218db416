"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings (all may be changed on a live session).
SETTINGS = {
    # Pages are large rows: bound what one Arrow batch can hold in a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above, hand the package to the workers, return the session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if spark.sparkContext.applicationId not in _shipped:
        _ship(spark)
    return spark


@contextmanager
def exact_names(spark: SparkSession) -> Iterator[None]:
    """Tell `Price` from `price` while a wide table is made, read or written.

    Its columns are named by the headers of any table on any page.
    """
    key = "spark.sql.caseSensitive"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):
        return  # runs from an archive the workers already have
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="leafmill-"), "leafmill"),
        "zip",
        root_dir=os.path.dirname(package),
        base_dir=os.path.basename(package),
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    ``spark.checkpoint.dir`` or the checkpoint directory of the context.  A
    session on one machine that names none (tests, a laptop) gets a temporary
    one; on a cluster that is an error, as each executor would write to a disk
    of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="leafmill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else writes to."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def store(frame: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the copy; `drop_stored` deletes it.

    Unlike an RDD checkpoint this computes the table once, and a lost executor
    only costs reading a file again.
    """
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    _stored.setdefault(frame.sparkSession.sparkContext.applicationId, []).append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


_stored: dict[str, list[str]] = {}


def drop_stored(spark: SparkSession) -> int:
    """Delete the copies that `store` made in this application; how many there were.

    Tables that still read from them can no longer be used.
    """
    paths = _stored.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return len(paths)
