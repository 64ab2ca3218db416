"""Sharding by a k-d tree over metadata.

A node of the tree is split along its widest dimension, measured against the
whole table, at the weighted median of bytes (for an odd number of leaves at the
matching quantile), until every leaf holds the target bytes.  The median is
found by histograms: each pass counts the bytes of up to ``BUCKETS`` intervals of
all nodes of a level and looks closer into the one that holds the median.  Ties
are ordered by the text's checksum, so that equal texts stay together as far as
sizes allow, then by a hash of the key.  A pass is an aggregation with partial
results; rows are never sorted or moved, and the driver sees at most about
``BUCKETS`` numbers of a pass.

Only DataFrame functions are used.

Cases: null text has one byte and checksum 0; null metadata is the smallest
value; rows that are equal in key, metadata and text share a shard; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.session import store

BUCKETS = 1 << 14
# A split may miss its quantile by this share of a leaf.
TOLERANCE = 0.0005
# Rows numbered by one task, about.
NUMBERED = 1 << 17
TOP = (1 << 63) - 1


def text_place(column: Column) -> Column:
    """A number in the order of a string's first six bytes; null: -1."""
    start = F.rpad(F.hex(F.substring(column.cast("string").cast("binary"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(start, 16, 10).cast("long"), F.lit(-1))


def number_place(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(-1))


@dataclass
class _Split:
    """The search for one node's quantile among (coordinate, checksum, hash)."""

    node: int
    leaves: int
    dimension: int
    wanted: float
    low: int
    high: int
    stage: int = 0
    before: float = 0.0
    fixed: tuple[int, ...] = ()
    bound: tuple[int, ...] | None = None  # rows below it go left

    def step(self, buckets: int) -> int:
        return (self.high - self.low) // buckets + 1


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: key, size (bytes + 1), text_crc32, shard, slot (gapless from 0 in a shard)."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    dims = dimensions or {
        "source": text_place(F.col("source")), "lang": text_place(F.col("lang")), "size": size,
    }
    rows = store(
        docs.select(
            F.col(key).alias("key"), size.alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("crc"),
            F.shiftrightunsigned(F.xxhash64(F.col(key)), 1).alias("hash"),
            F.array(*dims.values()).alias("place"),
        ), "kd-rows",
    )
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    leaves = shards or max(1, -(-(total or 0) // (target_bytes or 1)))
    placed = _descend(rows.withColumn("node", F.lit(0)), leaves, total or 0, len(dims))
    return _numbered(placed, n).withColumnRenamed("key", key)


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows known to the driver, as literals: no Python runs for them."""
    columns = [c.split() for c in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, columns)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _descend(rows: DataFrame, leaves: int, total: int, n_dims: int) -> DataFrame:
    """Rows with the number of their leaf as ``shard``."""
    spark, open_, whole, tolerance = rows.sparkSession, {0: leaves}, None, TOLERANCE * total / leaves
    numbers = {0: 0}  # first leaf of each node
    while any(k > 1 for k in open_.values()) and total:
        ends = [f(F.element_at("place", d + 1)).alias(f"{n}{d}") for d in range(n_dims) for n, f in (("low", F.min), ("high", F.max))]
        ranges = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()}
        whole = whole or ranges[0]
        splits = []
        for node, k in open_.items():
            if k < 2 or node not in ranges:
                continue
            r = ranges[node]
            width = [
                (r[f"high{d}"] - r[f"low{d}"]) / max(1, whole[f"high{d}"] - whole[f"low{d}"]) for d in range(n_dims)
            ]
            d = max(range(n_dims), key=lambda i: width[i])
            splits.append(_Split(node, k, d, r["size"] * (k // 2) / k, r[f"low{d}"], r[f"high{d}"]))
        if not splits:
            break
        while searching := [s for s in splits if s.bound is None]:
            _look(rows, searching, max(16, BUCKETS // len(searching)), tolerance)
        table = [(s.node, s.dimension, *s.bound) for s in splits]
        found = _small(spark, table, "node int, dim int, b0 long, b1 long, b2 long")
        # At most one row per shard.
        met = rows.join(F.broadcast(found), "node", "left")
        value = F.element_at("place", F.col("dim") + 1)
        below = (value < F.col("b0")) | (
            (value == F.col("b0"))
            & ((F.col("crc") < F.col("b1")) | ((F.col("crc") == F.col("b1")) & (F.col("hash") < F.col("b2"))))
        )
        child = F.col("node") * 2 + F.when(F.col("dim").isNull() | below, 1).otherwise(2)
        rows = met.select(*[c for c in rows.columns if c != "node"], child.cast("int").alias("node"))
        divided = {s.node for s in splits}
        new, first = {}, {}
        for node, k in open_.items():
            left = k // 2 if node in divided else 1  # a node without rows is done
            new[2 * node + 1], first[2 * node + 1] = left, numbers[node]
            if node in divided:
                new[2 * node + 2], first[2 * node + 2] = k - left, numbers[node] + left
        open_, numbers = new, first
    names = _small(spark, list(numbers.items()), "node int, shard int")
    return rows.join(F.broadcast(names), "node").drop("node", "place")


def _look(rows: DataFrame, splits: list[_Split], buckets: int, tolerance: float) -> None:
    """One pass over all searches of a level."""
    spark = rows.sparkSession
    table = [
        (s.node, s.dimension, s.stage, *(list(s.fixed) + [0, 0])[:2], s.low, s.high, s.step(buckets)) for s in splits
    ]
    searches = _small(
        spark, table, "node int, dim int, stage int, f0 long, f1 long, low long, high long, step long"
    )
    place = F.element_at("place", F.col("dim") + 1)
    value = F.when(F.col("stage") == 0, place).when(F.col("stage") == 1, F.col("crc")).otherwise(F.col("hash"))
    counted = (
        rows.join(F.broadcast(searches), "node")
        .withColumn("value", value)
        .filter((F.col("stage") == 0) | (place == F.col("f0")))
        .filter((F.col("stage") < 2) | (F.col("crc") == F.col("f1")))
        .filter("value between low and high")
        .groupBy("node", F.expr("(value - low) div step").alias("bucket"))
        .agg(F.sum("size").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    by_node: dict[int, list] = {}
    for row in counted.collect():
        by_node.setdefault(row["node"], []).append(row)
    for s in splits:
        rest = sorted(by_node[s.node], key=lambda r: r["bucket"])
        for at, row in enumerate(rest):
            if s.before + row["size"] >= s.wanted or at == len(rest) - 1:
                break
            s.before += row["size"]
        single = row["low"] == row["high"]
        if row["size"] <= tolerance or (single and s.stage == 2):
            nearer_above = s.wanted - s.before > row["size"] / 2
            edge = row["high"] + 1 if nearer_above and row["high"] < TOP else row["low"]
            s.bound = (*s.fixed, edge, 0, 0)[:3]
        elif single:
            s.fixed, s.stage = (*s.fixed, row["low"]), s.stage + 1
            s.low, s.high = (0, (1 << 32) - 1) if s.stage == 1 else (0, TOP - 1)
        else:
            s.low, s.high = row["low"], row["high"]


def _numbered(placed: DataFrame, n: int) -> DataFrame:
    """Rows with a gapless number in their shard, given in parts of bounded size."""
    parts = -(-n // NUMBERED) or 1
    rows = placed.withColumn("part", F.floor(F.col("hash") / (2.0**63) * parts))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("k"))
    ahead = F.sum("k").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("shard", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    own = F.row_number().over(W.partitionBy("shard", "part").orderBy("hash", "crc", "key", "size"))
    return rows.withColumn("own", own).join(sizes, ["shard", "part"]).select(
        "key", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("ahead") + F.col("own") - 1).alias("slot")
    )
