"""Prefix tries against plain loops."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.llm import trie
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def md5(role, text):
    return hashlib.md5(f"{len(role)} {role}{text}".encode()).hexdigest()[:30]


def conversations(rows):
    """Turns (role, text) of each conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {
        c: [t[2:] for t in sorted(turns, key=lambda t: (t[0], t[1], md5(*t[2:])))] for c, turns in out.items()
    }


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def nodes_of(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        words = len(brute.words(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(members[node]) - 1) * words
    found = set()
    for node, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if len(convs[c]) == len(node))))
        found.add((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children[node],
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    assert len(found) == len(members)
    return found


def got(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_conversations(spark):
    rows = [
        (r["conv_id"], r["turn"], r["role"], r["text"])
        for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    ]
    frame = entry.queries()["op13_prefix_trie"](spark, FOLDER)
    assert got(frame) == nodes_of(rebuilt(conversations(rows)))
    assert dict(frame.dtypes)["ends_sha256"] == "string"
    assert {kind for name, kind in frame.dtypes if name != "ends_sha256"} == {"bigint"}


@pytest.mark.parametrize(("band", "block", "chunk"), [(2, 3, 2), (3, 64, 1), (16, 4096, 4096)])
def test_odd_conversations_of_any_depth(spark, monkeypatch, band, block, chunk):
    """Copies, shared beginnings, nulls, ties, repeated rows, clashing columns, one deep conversation."""
    rng, rows = random.Random(band), []
    texts = ["", None, "a b", "a", "b\tc d", "x " * 500, "日本 語"]
    for conv in [*range(0, 45), 60, 61, 83, -1, -20, -41]:
        for turn in range(rng.choice([1, 1, 2, 3, 9])):
            rows.append((conv, turn, rng.choice(["user", None]), rng.choice(texts)))
    same = [(turn, "user", "same words") for turn in range(40)]
    rows += [(conv, *turn) for conv in (100, 101, 102, 140, 141) for turn in same[: 20 + conv % 40]]
    rows += [(100, None, "system", "first"), (101, 5, "user", "tie"), (101, 5, "user", "tie"), (101, 5, None, "z")]
    rows += [(7, 2, "user", "again")] * 9 + [(None, 1, "user", "nowhere"), (None, None, None, None)]
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie.ends_digests, "__defaults__", (chunk,))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for clash in ("depth", "a", "words", "x1", "place", "range", "length"):
        frame = frame.withColumn(clash, F.lit("clash"))
    members, turns = trie.with_shared_heads(trie.numbered_turns(frame))
    assert got(trie.prefix_trie(members, turns, band)) == nodes_of(rebuilt(conversations(rows)))


def test_plain_conversations(spark):
    """Without shared heads: the operator's own interface."""
    rows = [(c, t, "user", f"{t} {c * (t > 2)}") for c in range(6) for t in range(1 + c)]
    turns = trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    members = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    found = trie.prefix_trie(members, turns.withColumnRenamed("place", "depth"), band=2)
    assert got(found) == nodes_of(conversations(rows))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(*trie.with_shared_heads(trie.numbered_turns(empty))).count() == 0


def test_no_node_explodes_beyond_its_band(spark):
    """Rows that the rollup makes per named node stay within one band, at any depth."""
    rows = [(0, t, "user", str(t)) for t in range(300)]
    turns = trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("place", "depth")
    members = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    paths = trie._paths(members, turns)
    values = paths.select("conv_id", "depth", F.lit(1).cast("long").alias("n_leaves"), F.lit(1).cast("long").alias("saved_tokens"))
    sums = {r["depth"]: r["n_leaves"] for r in trie.subtree_sums(paths, values, 300, band=4).collect()}
    assert sums == {d: 301 - d for d in range(301)}
    assert trie._within_bands(paths, values, 4).count() == 301
