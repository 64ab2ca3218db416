"""Files of any store that Spark reaches: existence, sizes, safe replacement, atomic creation."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

PREVIOUS = ".previous"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    """The store of a path, and the path as that store takes it."""
    hadoop = _path(spark, path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = file_system(spark, path)
    return system.exists(hadoop)


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file, or of all files below a folder."""
    system, hadoop = file_system(spark, path)
    return system.getContentSummary(hadoop).getLength()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none when there is no such folder."""
    system, hadoop = file_system(spark, folder)
    if not system.exists(hadoop):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(hadoop))


def delete(spark: SparkSession, path: str) -> None:
    system, hadoop = file_system(spark, path)
    system.delete(hadoop, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, hadoop = file_system(spark, path)
    stream = system.open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole or not at all; an error when there is one of that name."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    system, hadoop = file_system(spark, aside)
    stream = system.create(hadoop, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            hadoop.toUri() if hadoop.toUri().getScheme() else system.getUri(), spark._jsc.hadoopConfiguration()
        )
        store.rename(hadoop, _path(spark, path), no_options)
    except Exception:
        system.delete(hadoop, False)
        raise


def recover(spark: SparkSession, path: str) -> None:
    """Put back what a replacement had moved aside when it ended before its new folder was in place."""
    system, target = file_system(spark, path)
    aside = _path(spark, path + PREVIOUS)
    if not system.exists(target) and system.exists(aside):
        system.rename(aside, target)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished folder in the place of an older one, if any, which is deleted last."""
    system, target = file_system(spark, path)
    aside, there = _path(spark, path + PREVIOUS), system.exists(target)
    if there:
        system.delete(aside, True)
        if not system.rename(target, aside):
            raise OSError(f"{path} cannot be moved aside")
    if not system.rename(_path(spark, new), target):
        if there:
            system.rename(aside, target)
        raise OSError(f"{new} cannot take the place of {path}")
    system.delete(aside, True)
