"""Saved rows as a table of runs: Parquet parts, and one small file that says which of them count.

A write puts its parts into folders of their own; only when all are there does a
new version file appear, whole and under the next number.  Readers take the
newest.  So a write that fails halfway, or is run again, leaves what was there
before, and of two writers at one time one is told.

    rows/run_ts=<run>/write=<id>/    the rows, one folder per write
    names/write=<id>/                the columns a wide table of them has, in order
    keys/write=<id>/bucket=<xx>/     content keys, by their first digits
    versions/<number>.json           folders that count

Saving a run replaces that run only.  Appending keeps rows whose content is not in
the table: it reads the keys of the buckets that the new rows fall into, no
saved row, and writes new rows and their keys.  Key folders are merged when as
many of a size have come together as ``FAN``, each key a logarithmic number of
times, so the files an append reads grow with the logarithm of the appends.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import content_hash
from leafmill.operators.dedup import dedup_content, dedup_full
from leafmill.operators.profile import column_order
from leafmill.session import store
from leafmill.sources import files

KEY = "content_key"
WRITE = "write"
FAN = 8
# Version files that stay for readers of older ones.
KEPT_VERSIONS = 20


# What the catalogue of columns holds of a write: where each name was first met.
NAMES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("written", T.LongType()),
        T.StructField("first_place", T.DecimalType(38, 0)),
        T.StructField("at", T.IntegerType()),
    ]
)


def scoped_key(scope: Sequence[str] = ()):
    """The content key of a row, told apart by the scope's values."""
    key = content_hash(F.col("text"), F.col("type"), F.col("source"))
    for name in scope:
        key = F.md5(F.concat_ws("|", key, F.coalesce(F.col(name).cast("string"), F.lit(""))))
    return key


class RowTable:
    """A table of saved rows below one path.

    ``digits``: how many hexadecimal digits of a key name its bucket, so 256
    buckets by default; fixed when the table is first written.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path, digits

    # Versions -----------------------------------------------------------

    def version(self) -> dict:
        """What counts at present: number, runs (run, write, rows), names, keys, schema."""
        numbers = [n for n in files.names_in(self.spark, self._at("versions")) if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "runs": [], "keys": [], "schema": None, "digits": self.digits, "scope": None}
        return json.loads(files.read_text(self.spark, self._at("versions", numbers[-1])))

    def _commit(self, found: dict, **changes) -> dict:
        new = found | changes | {"number": found["number"] + 1}
        files.create_text(self.spark, self._at("versions", f"{new['number']:020d}.json"), json.dumps(new))
        for name in files.names_in(self.spark, self._at("versions"))[:-KEPT_VERSIONS]:
            files.delete(self.spark, self._at("versions", name))
        return new

    def _at(self, *parts: str) -> str:
        return "/".join([self.path.rstrip("/"), *parts])

    # Reading ------------------------------------------------------------

    def runs(self) -> list[str]:
        return [r["run"] for r in self.version()["runs"]]

    def read(self, run: str | None = None) -> DataFrame:
        """All rows, or those of one run, with their ``run_ts``; an error when nothing was ever saved."""
        found = self.version()
        if found["schema"] is None:
            raise FileNotFoundError(f"nothing was saved at {self.path}")
        wanted = [r for r in found["runs"] if run is None or r["run"] == run]
        return self._rows(found, wanted)

    def _rows(self, found: dict, runs: list[dict]) -> DataFrame:
        kind = T.StructType.fromJson(found["schema"])
        return self._parts("rows", T.StructType([*kind, _text("run_ts")]), runs)

    def _parts(self, folder: str, kind: T.StructType, writes: list[dict]) -> DataFrame:
        """What some writes put below one of the folders; further columns are read from folder names."""
        if not writes:
            return self.spark.createDataFrame([], kind)
        reader = self.spark.read.schema(T.StructType([*kind, _text(WRITE)])).option("basePath", self._at(folder))
        return reader.parquet(*[self._folder(folder, w["write"], w.get("run")) for w in writes]).drop(WRITE)

    def columns(self, run: str | None = None) -> list[str]:
        """The columns of a wide table, in the order they were first met; known without reading rows."""
        wanted = [r for r in self.version()["runs"] if run is None or r["run"] == run]
        parts = self._parts("names", NAMES, [{"write": r["write"]} for r in wanted])
        first = parts.groupBy("name").agg(F.min(F.struct("written", "first_place", "at")).alias("met"))
        return [r["name"] for r in first.orderBy("met").select("name").collect()]

    # Writing ------------------------------------------------------------

    def save(self, rows: DataFrame, run: str, scope: Sequence[str] = (), full: bool = False) -> int:
        """Make these rows, without copies, the rows of a run; how many there are.

        What the run held before goes, other runs stay.
        """
        found = self.version()
        unique = (dedup_full if full else dedup_content)(rows, scope)
        kind, write = self._new_write(found, unique, run, scope)
        n = self._rows(found | {"schema": kind}, [write]).count()
        runs = [r for r in found["runs"] if r["run"] != run] + [write | {"rows": n}] * (n > 0)
        # The index is made again from the rows when it is next asked for.
        self._commit(found, runs=runs, schema=kind, keys=None, scope=list(scope), digits=found["digits"])
        return n

    def append(self, rows: DataFrame, run: str, scope: Sequence[str] = ()) -> int:
        """Add the rows whose (text, type, source) the table does not hold; how many they are.

        Absent values count as ''.  A run that is already there is left as it is,
        so that a batch may be given twice.
        """
        found = self.version()
        if run in [r["run"] for r in found["runs"]]:
            return 0
        if found["scope"] not in (None, list(scope)):
            raise ValueError(f"rows were saved with the scope {found['scope']}")
        found = self._indexed(found, scope)
        unique = dedup_content(rows, scope).withColumn(KEY, scoped_key(scope))
        if found["keys"]:
            unique = store(unique, "new-rows")
            bucket = self._bucket(found)
            hit = [r["bucket"] for r in unique.select(bucket.alias("bucket")).distinct().collect()]
            known = self.keys(found).filter(F.col("bucket").isin(hit)).select(KEY)
            unique = unique.join(known, KEY, "left_anti")
        kind, write = self._new_write(found, unique, run, scope)
        new = self._rows(found | {"schema": kind}, [write])
        n = new.count()
        keys = self._merged(found, found["keys"] + ([self._write_keys(found, new.select(KEY), n)] if n else []))
        runs = found["runs"] + [write | {"rows": n}]
        self._commit(found, runs=runs, schema=kind, keys=keys, scope=list(scope))
        return n

    def _new_write(self, found: dict, rows: DataFrame, run: str, scope: Sequence[str]) -> tuple[dict, dict]:
        if KEY not in rows.columns:
            rows = rows.withColumn(KEY, scoped_key(scope))
        kind = found["schema"]
        if kind is None:
            kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).jsonValue()
        names = [f["name"] for f in kind["fields"]]
        if not re.fullmatch(r"[\w.\-]+", run):
            raise ValueError(f"a run is named by letters, digits, '_', '-' and '.': {run}")
        if more := (set(rows.columns) - set(names)) | ({"run_ts", WRITE} & set(names)):
            raise ValueError(f"the saved rows cannot have columns {sorted(more)}")
        types = {f.name: f.dataType for f in T.StructType.fromJson(kind)}
        rows = rows.select(
            *[(F.col(n) if n in rows.columns else F.lit(None)).cast(types[n]).alias(n) for n in names]
        )
        write = {"run": run, "write": uuid.uuid4().hex}
        rows.write.parquet(self._folder("rows", write["write"], run))
        new = self.spark.read.schema(T.StructType.fromJson(kind)).parquet(self._folder("rows", write["write"], run))
        order = column_order(new).select(
            "name", F.lit(found["number"]).cast("long").alias("written"),
            F.col("first_met.first_place").cast("decimal(38,0)").alias("first_place"),
            F.col("first_met.at").cast("int").alias("at"),
        )
        order.coalesce(1).write.parquet(self._folder("names", write["write"]))
        return kind, write

    def _folder(self, kind: str, write: str, run: str | None = None) -> str:
        return self._at(kind, *([f"run_ts={run}"] if run is not None else []), f"write={write}")

    # Keys ---------------------------------------------------------------

    @staticmethod
    def _bucket(found: dict):
        return F.substring(KEY, 1, found["digits"])

    def keys(self, found: dict | None = None) -> DataFrame:
        """`(content_key, bucket)` of every appended row."""
        found = found or self.version()
        return self._parts("keys", T.StructType([_text(KEY), _text("bucket")]), found["keys"] or [])

    def _write_keys(self, found: dict, keys: DataFrame, n: int) -> dict:
        write = uuid.uuid4().hex
        buckets = keys.select(KEY, self._bucket(found).alias("bucket")).repartition("bucket")
        buckets.write.partitionBy("bucket").parquet(self._folder("keys", write))
        return {"write": write, "rows": n}

    def _indexed(self, found: dict, scope: Sequence[str]) -> dict:
        """The version with an index; made from the rows' keys after runs were replaced."""
        if found["keys"] is not None:
            return found
        n = sum(r["rows"] for r in found["runs"])
        keys = self._rows(found, found["runs"]).select(KEY)
        return found | {"keys": [self._write_keys(found, keys, n)] if n else []}

    def _merged(self, found: dict, parts: list[dict]) -> list[dict]:
        """The key folders, ``FAN`` of one size made one of the next, until no size has so many."""
        size = 0
        while any(_size(p["rows"]) >= size for p in parts):
            same = [p for p in parts if _size(p["rows"]) == size]
            if len(same) >= FAN:
                keys = self.keys(found | {"keys": same}).select(KEY)
                merged = self._write_keys(found, keys, sum(p["rows"] for p in same))
                parts = [p for p in parts if p not in same] + [merged]
            size += 1
        return parts

    # Housekeeping -------------------------------------------------------

    def clean(self) -> int:
        """Delete folders that the present version does not name (failed, replaced or merged); how many.

        Not while others write or read older versions.
        """
        found = self.version()
        used = {r["write"] for r in found["runs"]} | {k["write"] for k in found["keys"] or []}
        gone = 0
        folders = [self._at("names"), self._at("keys")]
        folders += [self._at("rows", run) for run in files.names_in(self.spark, self._at("rows"))]
        for folder in folders:
            for name in files.names_in(self.spark, folder):
                if name.startswith("write=") and name.removeprefix("write=") not in used:
                    files.delete(self.spark, os.path.join(folder, name))
                    gone += 1
        return gone


def _text(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def _size(rows: int) -> int:
    """The power of `FAN` that a folder of so many keys belongs to."""
    power = 0
    while rows >= FAN:
        rows //= FAN
        power += 1
    return power
