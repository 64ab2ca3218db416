"""Prefix tries of conversations with subtree totals by a depth-band rollup.

A node is a sequence of first turns that one or more conversations share.  Its
name is the exclusive or of one hash per turn and place, in two independent
64-bit lanes: a name needs no chain from turn to turn, so one conversation may
be longer than a task, and a parent's name is the node's without its last turn.

*Rollup.*  Depths are cut into bands of ``BAND``.  A node adds its own values to
its ancestors inside its band only, as its smallest member knows them: at most
``BAND`` rows for each conversation and band, however many nodes it names there.
The tops of the bands, each with the total of its band below it, are a trie of
their own, ``BAND`` times lower, which is summed in the same way; a top's
completed total then goes to its ancestors in the band above.  So the rounds
grow with the logarithm of the deepest conversation and no node ever explodes to
more than a band.

*Places.*  Rows are dealt by ranges of (conversation, turn), also within one
conversation; numbers within a range plus those of earlier ranges are places.

*Ends.*  SHA-256 reads its input in order, so the members that end at one node
are joined to strings of ``CHUNK`` ids in parallel and then read as a stream,
batch by batch, by one task; nothing is held but the state of the hash.

Cases: rows without a conversation take no part; a null turn comes first, ties
go by the md5 of role and text, and equal rows are separate turns; null roles
and texts are empty; an empty table has no node; further columns are not read.
Turns are told apart by 120 bits of md5.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import WORD
from leafmill.session import store

BAND = 16
# Turns of one conversation that a task puts in order at a time.
BLOCK = 4096
# Ids in one string that is hashed.
CHUNK = 4096

ID = ["depth", "x1", "x2"]
SUMS = ["n_leaves", "saved_tokens"]


def numbered_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (conv_id, place, a, b, words): each turn's place from 1, its name in two halves, its words."""
    name = F.md5(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text").cast("binary"))
    turns = (
        rows.filter(F.col(conv).isNotNull())
        .select(
            F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
            F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
        )
        .select("conv_id", "turn", name.alias("name"), F.regexp_count("text", F.lit(WORD)).alias("words"))
        .select(
            "conv_id", "turn", F.conv(F.substring("name", 1, 15), 16, 10).cast("long").alias("a"),
            F.conv(F.substring("name", 16, 15), 16, 10).cast("long").alias("b"), "words",
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("row")]
    ranged = turns.repartitionByRange(F.col("conv_id"), *order).withColumn("range", F.spark_partition_id())
    ranged = store(ranged, "trie-ranges")
    before = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    earlier = (
        ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("rows"))
        .select("conv_id", "range", F.sum("rows").over(before).alias("earlier")).filter("earlier > 0")
    )
    place = F.row_number().over(W.partitionBy("conv_id", "range").orderBy(*order)).cast("long")
    return (
        ranged.withColumn("place", place).join(earlier, ["conv_id", "range"], "left")
        .select("conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("place"), "a", "b", "words")
    )


def with_shared_heads(turns: DataFrame, group: int = 20, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another, as forks of a chat do.

    The first h turns of conversation c become those of conversation c - c % group
    (all it has, if fewer; none, if there is none), where h is crc32 of c's
    decimal digits modulo ``longest`` + 1.  Returns rows (conv_id, length) and
    rows (conv_id, depth, a, b, words).
    """
    turns = store(turns, "trie-turns")
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") <= longest))
    counts = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("there"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    convs = (
        turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
        .select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
        .join(counts, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
        .withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    )
    convs = store(convs, "trie-conversations")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "words"
    )
    head = heads.select(F.col("conv_id").alias("base"), "place", "a", "b", "words")
    begun = convs.filter("taken > 0").join(head, "base").filter("place <= h").select(
        "conv_id", F.col("place").alias("depth"), "a", "b", "words"
    )
    return convs.select("conv_id", "length"), rest.union(begun)


def _paths(members: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, x1, x2, p1, p2, words): every node of every conversation, with its parent's name."""
    terms = turns.select(
        "conv_id", "depth", "words", F.expr(f"depth div {BLOCK}").alias("block"),
        F.xxhash64("a", "b", "depth").alias("t1"), F.xxhash64(F.lit(1), "b", "a", "depth").alias("t2"),
    )
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    earlier = (
        terms.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
        .select("conv_id", "block", F.bit_xor("x1").over(before).alias("e1"), F.bit_xor("x2").over(before).alias("e2"))
        .filter("e1 is not null")
    )
    run = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    named = (
        terms.withColumn("x1", F.bit_xor("t1").over(run)).withColumn("x2", F.bit_xor("t2").over(run))
        .join(earlier, ["conv_id", "block"], "left")
        .withColumn("x1", F.col("x1").bitwiseXOR(F.coalesce("e1", F.lit(0).cast("long"))))
        .withColumn("x2", F.col("x2").bitwiseXOR(F.coalesce("e2", F.lit(0).cast("long"))))
        .select(
            "conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("t1")).alias("p1"),
            F.col("x2").bitwiseXOR(F.col("t2")).alias("p2"), "words",
        )
    )
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    top = members.select(
        "conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"),
        F.lit(0).alias("words"),
    )
    return named.union(top)


def _within_bands(paths: DataFrame, values: DataFrame, band: int) -> DataFrame:
    """Per node the sums over its subtree as far as its band reaches.

    ``values``: one row (conv_id, depth, sums) per node, at its smallest member.
    """
    rows = paths.select("conv_id", *ID).join(values.select("conv_id", "depth", *SUMS), ["conv_id", "depth"], "left")
    bands = (
        rows.groupBy("conv_id", F.expr(f"depth div {band}").alias("band"))
        .agg(F.sort_array(F.collect_list(F.struct(*ID, *SUMS))).alias("line"), F.count(SUMS[0]).alias("named"))
        .filter("named > 0")
    )

    def at_or_below(name):
        def total(i):
            return F.aggregate(
                F.slice("line", i + 1, F.lit(band)), F.lit(0).cast("long"),
                lambda s, node: s + F.coalesce(node[name], F.lit(0).cast("long")),
            )

        return total

    sums = [at_or_below(name) for name in SUMS]
    line = F.transform(
        "line", lambda node, i: F.struct(*[node[c].alias(c) for c in ID], *[s(i).alias(n) for s, n in zip(sums, SUMS)])
    )
    spread = bands.select("conv_id", F.explode(line).alias("node")).select("conv_id", "node.*")
    return _added(spread)


def _added(rows: DataFrame) -> DataFrame:
    """One row per node; the smallest of the conversations that name it is its smallest member."""
    return rows.groupBy(*ID).agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS])


def subtree_sums(paths: DataFrame, values: DataFrame, deepest: int, band: int = BAND) -> DataFrame:
    """Rows (depth, x1, x2, conv_id, sums) of the sums over whole subtrees."""
    inside = store(_within_bands(paths, values, band), "trie-bands")
    if deepest < band:
        return inside
    is_top = F.col("depth") % band == 0
    up = F.expr(f"depth div {band}")
    tops = subtree_sums(
        paths.filter(is_top).withColumn("depth", up), inside.filter(is_top).withColumn("depth", up),
        deepest // band, band,
    ).withColumn("depth", F.col("depth") * band)
    # A completed top of one band belongs to the subtrees of its ancestors in the band above.
    ending = tops.filter("depth > 0").select("conv_id", (up - 1).alias("band"), *SUMS)
    passed = (
        paths.filter(~is_top).withColumn("band", up).join(ending, ["conv_id", "band"])
        .select(*ID, "conv_id", *SUMS)
    )
    others = _added(inside.filter(~is_top).select(*ID, "conv_id", *SUMS).union(passed))
    return store(others.select(*ID, "conv_id", *SUMS).union(tops.select(*ID, "conv_id", *SUMS)), "trie-sums")


def _runs(names: list[np.ndarray]) -> list[int]:
    """Where the node changes in sorted rows, with both ends."""
    n = len(names[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for column in names:
        new[1:] |= column[1:] != column[:-1]
    return [*np.flatnonzero(new).tolist(), n]


def ends_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (depth, x1, x2, ends_sha256): SHA-256 of the decimal ids, ascending, joined by commas."""
    kind = ends.schema["conv_id"].dataType.simpleString()

    def joined(batches):
        held, first, ids = None, None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], pa.int64()) for v in held], pa.array([first]), pa.array([",".join(ids)])],
                names=[*ID, "first", "ids"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            names, convs = [np.asarray(batch.column(i)) for i in range(3)], batch.column(3).to_pylist()
            cuts = _runs(names)
            for begin, end in zip(cuts, cuts[1:]):
                name = tuple(int(c[begin]) for c in names)
                if held is not None and (name != held or len(ids) >= chunk):
                    yield out()
                    ids = []
                if not ids:
                    held, first = name, convs[begin]
                ids.extend(map(str, convs[begin:end]))
        if held is not None:
            yield out()

    def hashed(batches):
        held, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, strings, done = [np.asarray(batch.column(i)) for i in range(3)], batch.column(4), []
            cuts = _runs(names)
            for begin, end in zip(cuts, cuts[1:]):
                name = tuple(int(c[begin]) for c in names)
                for at in range(begin, end):
                    part = strings[at].as_py().encode()
                    if name == held:
                        state.update(b"," + part)
                    else:
                        if held is not None:
                            done.append((*held, state.hexdigest()))
                        held, state = name, hashlib.sha256(part)
            if done:
                yield _digests(done)
        if held is not None:
            yield _digests([(*held, state.hexdigest())])

    def _digests(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*ID, "ends_sha256"])

    names = ", ".join(f"{c} long" for c in ID)
    ranged = ends.select(*ID, "conv_id").repartitionByRange(*ID, "conv_id").sortWithinPartitions(*ID, "conv_id")
    chunks = ranged.mapInArrow(joined, f"{names}, first {kind}, ids string")
    return (
        chunks.repartition(*[F.col(c) for c in ID]).sortWithinPartitions(*ID, "first")
        .mapInArrow(hashed, f"{names}, ends_sha256 string")
    )


def prefix_trie(members: DataFrame, turns: DataFrame, band: int = BAND) -> DataFrame:
    """All nodes of the trie of some conversations.

    ``members``: one row (conv_id, length) per conversation; ``turns``: (conv_id,
    depth from 1, a, b, words), as `numbered_turns` names them.  Per node:
    conv_id (its smallest member; the node's last turn is the depth-th of that),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over its
    subtree, the words of last turns that members but the first need not read
    again), ends_sha256 (of the members that end here).
    """
    paths = store(_paths(members, turns), "trie-paths")
    nodes = paths.groupBy(*ID).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        *[F.max(c).alias(c) for c in ("words", "p1", "p2")],
    )
    nodes = store(nodes, "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ID, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = store(nodes, "trie-nodes")
    values = nodes.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(paths.select("conv_id", *ID), values, deepest, band).drop("conv_id")
    ends = paths.select("conv_id", *ID).join(
        members.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]
    )
    digests = ends_digests(ends)
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(sums, ID).join(digests, ID, "left").join(parents, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *SUMS,
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
