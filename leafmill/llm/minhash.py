"""Near copies by one-permutation MinHash with optimal densification.

One hash per shingle gives a whole signature: the upper bits choose one of
``bands * rows`` bins, and a bin keeps its smallest hash.  An empty bin takes the
value of the first filled bin in an order of its own that is the same for all sets,
so two sets still agree in a bin with about the probability of their
similarity.  Sets that agree in all rows of a band share a bucket.

*Stars.*  A bucket proposes only pairs with its centre: the member with the most
company over all its buckets, likely the original of a group.  Every set is
first compared with its likeliest centre, then with the centres of other classes.
Links are confirmed on the whole sets of both texts.

*What stars leave.*  Two members may be similar while neither is to the centre.
Of the sets in buckets with members outside the centre's class, the rare shingles (of at
most ``RARE`` sets) are counted: a pair overlaps in the rare ones it shares, found
by a join of bounded groups, and in no more than the smaller *core* of other shingles.  Only where that is enough for a
link is it compared.  Pairs without a common rare shingle need large
cores: such outsiders are compared with all members of other classes, if
there are at most ``FEW`` of them, so pairs stay linear in rows.  The sets of more crowded buckets are put into buckets again
with the longer bands of the next level, which sets of little similarity
leave; the last level compares whatever remains.

A pair of similarity s misses every bucket of the first level with a
probability of (1 - s^4)^40: 6e-10 at 0.8.  For small sets, whose share of
agreeing bins strays from s, that is up to about 2e-3 at the worst; tests
compare whole classes with plain loops.

Equal sets are one entity, known by 128 bits, from the start.

Cases: null, empty and blank texts have no shingles and link with nothing; texts
shorter than n words have one; rows of one key are separate rows; of null keys the
smallest other key of the class is reported, or null, and they are kept in classes
without any other key; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import map_batches, mix, starts_of
from leafmill.llm.components import connected_components
from leafmill.llm.ngram_join import shingle_sets
from leafmill.session import store

# (rows of a band, bands), for all sets, then for those of crowded buckets.
LEVELS = ((4, 40), (8, 160), (12, 480))
# Members outside the centre's class that a bucket compares with all others.
FEW = 4096
# Shingles of so many sets are rare.
RARE = 12
# Parts of the hash space that sets are compared by.
CELLS = 128

_ODD = np.uint64(0x9E3779B97F4A7C15)


def signature(grams: np.ndarray, counts: np.ndarray, bins: int, seed: int = 1) -> np.ndarray:
    """One value per set and bin; ``grams``: the distinct hashes of all sets in a row, none empty."""
    hashed = mix((grams.view(np.uint64) + np.uint64(seed)) * _ODD)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    place = owner * bins + ((hashed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(place), dtype=bool)
    first[1:] = place[1:] != place[:-1]
    out, filled = np.zeros(len(counts) * bins, np.uint64), np.zeros(len(counts) * bins, bool)
    out[place[first]], filled[place[first]] = hashed[first], True
    return _densified(out.reshape(-1, bins), filled.reshape(-1, bins))


def _densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first filled bin among places drawn for that bin."""
    bins = np.uint64(values.shape[1])
    out = values.copy()
    row, bin_ = np.nonzero(~filled)
    single = filled.sum(1) == 1  # where every draw ends at the same bin
    if single.any():
        out[single] = values[single].max(1, keepdims=True)
        row, bin_ = row[~single[row]], bin_[~single[row]]
    draw = 0
    while len(row):
        draw += 1
        drawn = (mix(bin_.astype(np.uint64) * _ODD + np.uint64(draw)) % bins).astype(np.int64)
        hit = filled[row, drawn]
        out[row[hit], bin_[hit]] = values[row[hit], drawn[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def buckets(grams: np.ndarray, counts: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """The bucket of each set (line) in each band (column)."""
    values = signature(grams, counts, rows * bands, seed=rows).reshape(len(counts), bands, rows)
    found = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(rows << 32)), values.shape[:2])
    for at in range(rows):
        found = mix((found ^ values[:, :, at]) * _ODD)
    return found.view(np.int64)


def _lists(table: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(table) + 1) * table.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(table.ravel()))


def _marked(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Per row: key, tid (hash of the text), entity (hash of the set), size, buckets of the first level."""

    def run(batch):
        grams, counts = shingle_sets(batch.column(2), n)
        begin = starts_of(counts)
        entity = [xxhash.xxh3_128_digest(grams[b : b + c].tobytes()) for b, c in zip(begin, counts)]
        some = counts > 0
        found = np.zeros((len(counts), LEVELS[0][1]), np.int64)
        found[some] = buckets(grams, counts[some], *LEVELS[0])
        columns = [batch.column(0), batch.column(1), pa.array(entity, pa.binary()), pa.array(counts, pa.int64())]
        names = ["key", "tid", "entity", "n", "buckets"]
        return pa.RecordBatch.from_arrays([*columns, _lists(found)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    return map_batches(rows, run, f"key {kind}, tid long, entity binary, n long, buckets array<long>")


def _starred(sets: DataFrame) -> DataFrame:
    """Rows (entity, n, bucket, centre, m, weight) of the buckets with several sets, with their centres."""
    rows = sets.select("entity", "n", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = store(rows.join(shared, "bucket"), "minhash-buckets")
    company = rows.groupBy("entity").agg(F.sum(F.floor(16 * F.log2("size"))).alias("weight"))
    weighed = store(rows.drop("size").join(company, "entity"), "minhash-buckets")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "entity", "n")).alias("c")).select(
        "bucket", F.col("c.entity").alias("centre"), F.col("c.n").alias("m"), F.col("c.weight").alias("weight")
    )
    return store(weighed.drop("weight").join(centres, "bucket"), "minhash-stars")


def _long_enough(percent: int, n: str, m: str):
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _likeliest(starred: DataFrame, percent: int) -> DataFrame:
    """Each set with the centre that has the most company."""
    edges = starred.filter("entity <> centre").filter(_long_enough(percent, "n", "m"))
    best = edges.groupBy("entity").agg(F.max(F.struct("weight", "centre"))["centre"].alias("centre"))
    return best.select(*_pair("entity", "centre")).distinct()


def _classed(starred: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the class of the set (own) and of the centre (main)."""
    own = labels.select(F.col("id").alias("entity"), F.col("label").alias("own"))
    main = labels.select(F.col("id").alias("centre"), F.col("label").alias("main"))
    return (
        starred.join(own, "entity", "left").join(main, "centre", "left")
        .withColumn("own", F.coalesce("own", "entity")).withColumn("main", F.coalesce("main", "centre"))
    )


def _outside(classed: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of other classes with the centre."""
    edges = classed.filter("own <> main").filter(_long_enough(percent, "n", "m"))
    return edges.select(*_pair("entity", "centre")).distinct()


def _mixed(classed: DataFrame) -> DataFrame:
    """The rows of buckets with members outside the centre's class."""
    mixed = classed.filter("own <> main").select("bucket").distinct()
    return store(classed.join(mixed, "bucket", "left_semi"), "minhash-mixed")


def _rare_shingles(rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Rows (gram, sets, entity): the shingles that at most ``RARE`` of the sets of these rows have."""

    def shingles(batch):
        grams, counts = shingle_sets(batch.column(1), n)
        owner = np.repeat(np.arange(len(counts)), counts)
        return pa.RecordBatch.from_arrays([pa.array(grams), batch.column(0).take(pa.array(owner))], names=["gram", "entity"])

    sets = texts.join(rows.select("entity").distinct(), "entity", "left_semi")
    held = map_batches(sets, shingles, "gram long, entity binary")
    few = held.groupBy("gram").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") <= RARE)
    return store(held.join(few, "gram"), "minhash-rare")


def _cores(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """Per set: entity, n, own (its class), core (the shingles that are not rare)."""
    sets = rows.select("entity", "n", "own").distinct()
    counts = rare.groupBy("entity").agg(F.count(F.lit(1)).alias("rare"))
    core = F.col("n") - F.coalesce("rare", F.lit(0))
    return store(sets.join(counts, "entity", "left").select("entity", "n", "own", core.alias("core")), "minhash-cores")


def _enough(percent: int, overlap: str, n: str, m: str):
    return F.expr(f"{100 + percent} * ({overlap}) >= {percent} * ({n} + {m})")


def _by_rare(rare: DataFrame, cores: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share rare shingles, enough of them beside the smaller core for a link."""
    rows = rare.filter("sets > 1").join(cores, "entity").drop("sets")
    others = rows.select("gram", *[F.col(c).alias(f"{c}_2") for c in ("entity", "n", "own", "core")])
    met = rows.join(others, "gram").filter("entity < entity_2 and own <> own_2").filter(_long_enough(percent, "n", "n_2"))
    shared = met.groupBy("entity", "entity_2").agg(
        F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("n", "n_2", "core", "core_2")]
    )
    likely = shared.filter(_enough(percent, "least(core, core_2) + shared", "n", "n_2"))
    return likely.select(F.col("entity").alias("a"), F.col("entity_2").alias("b"))


def _by_core(classed: DataFrame, cores: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of sets whose core alone could do with the smallest set of their bucket, with core and cells.

    ``cells``: how many shingles of the set fall into each part of the hash space.
    """

    def cells(batch):
        grams, counts = shingle_sets(batch.column(1), n)
        owner = np.repeat(np.arange(len(counts)), counts)
        cell = owner * CELLS + ((grams.view(np.uint64) >> np.uint64(32)) * np.uint64(CELLS) >> np.uint64(32)).astype(np.int64)
        table = np.bincount(cell, minlength=len(counts) * CELLS).reshape(-1, CELLS)
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(table)], names=["entity", "cells"])

    rows = classed.join(cores.select("entity", "core"), "entity").filter(F.expr(f"100 * core >= {percent} * n"))
    least = rows.groupBy("bucket").agg(F.min("n").alias("least"))
    rows = store(rows.join(least, "bucket").filter(_enough(percent, "core", "n", "least")).drop("least"), "minhash-cores")
    sets = texts.join(rows.select("entity").distinct(), "entity", "left_semi")
    return rows.join(map_batches(sets, cells, "entity binary, cells array<long>"), "entity")


def _crossing(rows: DataFrame, crowds: DataFrame, percent: int) -> DataFrame:
    """Pairs of members outside the centre's class with the members of other classes, by their cores alone.

    Sets differ by no less than their cells do, which leaves out most pairs that
    no link could join.
    """
    outer = rows.filter("own <> main").join(crowds, "bucket", "left_semi").select(
        "bucket", F.col("entity").alias("other"), F.col("n").alias("o"), F.col("core").alias("most"),
        F.col("own").alias("class"), F.col("cells").alias("other_cells"),
    )
    apart = F.aggregate(
        F.zip_with("cells", "other_cells", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x
    )
    alike = (100 + percent) * (F.col("n") + F.col("o") - apart) >= 2 * percent * (F.col("n") + F.col("o"))
    once = F.expr("own = main or entity < other")
    met = rows.join(outer, "bucket").filter("own <> class").filter(once & _long_enough(percent, "n", "o"))
    met = met.filter(_enough(percent, "least(core, most)", "n", "o") & alike)
    return met.select(*_pair("entity", "other")).distinct()


def _texts(of: DataFrame, marked: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """One text for each of these sets: that of its smallest row."""
    chosen = marked.join(of, "entity", "left_semi").groupBy("entity").agg(F.min(F.struct("key", "tid")).alias("row"))
    chosen = chosen.select("entity", F.col("row.key").alias("key"), F.col("row.tid").alias("tid"))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("tid"), F.col(text).alias("text"))
    same = chosen["key"].eqNullSafe(rows["k"]) & (chosen["tid"] == rows["tid"])
    # Equal rows hold one text; the first will do.
    return chosen.join(rows, same).groupBy("entity").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) with whether their whole sets are similar enough."""
    one = texts.select(F.col("entity").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("entity").alias("b"), F.col("text").alias("text_b"))

    def sets(column):
        coded = column.dictionary_encode()  # a centre meets many sets
        grams, counts = shingle_sets(coded.dictionary, n)
        begin = starts_of(counts)
        each = [grams[b : b + c] for b, c in zip(begin, counts)]
        return [each[i] for i in coded.indices.to_pylist()]

    def run(batch):
        linked = []
        for a, b in zip(sets(batch.column(2)), sets(batch.column(3))):
            common = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(100 * common >= percent * (len(a) + len(b) - common))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
        )

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return map_batches(joined, run, "a binary, b binary, linked boolean")


class _Links:
    """Pairs compared so far, and the classes that their links make."""

    def __init__(self, texts: DataFrame, n: int, percent: int):
        self.texts, self.n, self.percent = texts, n, percent
        self.tables: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> None:
        if self.tables:
            known = reduce(DataFrame.union, self.tables).select("a", "b")
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = store(pairs, "minhash-pairs")
        compared = store(_confirmed(pairs, self.texts, self.n, self.percent), "minhash-links")
        self.tables.append(compared)
        new = compared.filter("linked").select("a", "b")
        if self.labels is None:
            self.labels = connected_components(new)
        elif not new.isEmpty():
            self._merge(new)

    def _merge(self, new: DataFrame) -> None:
        """Let new links make classes one."""
        for end in ("a", "b"):
            own = self.labels.select(F.col("id").alias(end), F.col("label").alias("class"))
            new = new.join(own, end, "left").withColumn(end, F.coalesce("class", end)).drop("class")
        merged = connected_components(new)
        to = merged.select(F.col("id").alias("label"), F.col("label").alias("to"))
        known = self.labels.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        fresh = merged.join(self.labels, "id", "left_anti")
        self.labels = store(known.union(fresh), "minhash-labels")


def _again(texts: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """Rows (entity, n, buckets) of these texts at a further level."""

    def run(batch):
        grams, counts = shingle_sets(batch.column(1), n)
        columns = [batch.column(0), pa.array(counts, pa.int64()), _lists(buckets(grams, counts, rows, bands))]
        return pa.RecordBatch.from_arrays(columns, names=["entity", "n", "buckets"])

    return map_batches(texts, run, "entity binary, n long, buckets array<long>")


def minhash_components(
    docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``key``, ``n_shingles``, ``component_id`` (the smallest key it is linked to) and ``kept``.

    Rows link when 100 * intersection >= percent * union of their n-gram sets;
    a row is kept when its key is its class's.
    """
    marked = store(_marked(docs, key, text, n), "minhash-sets")
    sets = marked.filter("n > 0")
    entities = sets.groupBy("entity").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    texts = links = None
    for level in range(len(LEVELS)):
        starred = _starred(entities)
        if links is None:
            texts = store(_texts(starred.select("entity").distinct(), marked, docs, key, text), "minhash-texts")
            links = _Links(texts, n, percent)
        links.compare(_likeliest(starred, percent))
        links.compare(_outside(_classed(starred, links.labels), percent))
        rows = _mixed(_classed(starred, links.labels))
        rare = _rare_shingles(rows, texts, n)
        cores = _cores(rows, rare)
        links.compare(_by_rare(rare, cores, percent))
        # What shares no rare shingle can only overlap in the cores.
        rows = store(_by_core(_classed(starred, links.labels), cores, texts, n, percent), "minhash-crossing")
        crowds = rows.filter("own <> main").groupBy("bucket").agg(F.count(F.lit(1)).alias("outside"))
        last = level + 1 == len(LEVELS)
        links.compare(_crossing(rows, crowds if last else crowds.filter(F.col("outside") <= FEW), percent))
        if last:
            break
        crowded = rows.join(crowds.filter(F.col("outside") > FEW), "bucket", "left_semi").select("entity").distinct()
        crowded = store(crowded, "minhash-crowded")
        if crowded.isEmpty():
            break
        entities = _again(texts.join(crowded, "entity", "left_semi"), n, *LEVELS[level + 1])
    named = sets.select("key", "entity", "n").join(
        links.labels.withColumnRenamed("id", "entity"), "entity", "left"
    ).withColumn("label", F.coalesce("label", "entity"))
    # Stored, so that the join's large side may be split where one class holds many rows.
    smallest = store(named.groupBy("label").agg(F.min("key").alias("component_id")), "minhash-smallest")
    linked = named.join(smallest, "label").select("key", "n", "component_id")
    alone = marked.filter("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return linked.union(alone).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id",
        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"),
    )
