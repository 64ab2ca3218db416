"""Jaccard join on word n-grams with rare-first prefix filtering.

Two sets with similarity t or more share a token among their first
``n - ceil(t n) + 1`` tokens, in any order of tokens that all sets use.  The
order used here puts the rarest first.  To know how rare tokens are without
moving all of them, it is made of two parts: first the tokens whose hash falls
into a fixed *region* of the hash space, a third wider than a prefix needs,
ordered by their number of sets; then the others.  Almost every prefix lies
inside the region, so only the region's tokens are counted and joined.  A set
whose region is shorter than its prefix sends all its tokens: of two such sets
the common token may be anywhere, and any other pair meets inside the region.

Pairs that share a prefix token pass the length filter, the positional filter
(tokens left after the shared one) and the suffix filter (the hash space is cut
at fixed places; differences of the counts between cuts bound the overlap from
above).  What is left is compared on the texts, once per pair.

Only classes of linked documents are asked for, so no group is paired with
itself: first every set is compared with one partner, the likeliest original of
a group it is in, then only pairs whose classes still differ are.  Sets that
still meet others on a crowded token are joined once more on all their tokens.
Equal sets are one entity from the start.

Cases: null, empty and blank texts have no tokens and link with nothing, texts
shorter than n words have one token; rows with equal keys are separate rows; of
null keys only the smallest non-null key of the class is reported, or null.
Further columns are not read.  Tokens and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import hash_words, map_batches, mix, split_words, starts_of
from leafmill.llm.components import connected_components
from leafmill.session import store

# Width of the region, in prefixes.
MARGIN = 1.34
# Cuts of the hash space for the suffix filter.
CELLS = 64
# Tokens of more sets than this are crowded.
FEW = 32
LOWEST = -(1 << 63)


def needed(percent: int, n):
    """Smallest overlap with a set of n tokens at this similarity: ceil(t n)."""
    return (n * percent + 99) // 100


def region_end(percent: int) -> int:
    """Tokens whose signed hash is below this are in the region."""
    return LOWEST + int(min(0.999, (100 - percent) / 100 * MARGIN) * (1 << 64))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as sorted signed hashes, in a row, and their numbers."""
    words, counts = split_words(pc.ascii_lower(texts))
    hashes, begin = hash_words(words), starts_of(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    size = max(len(hashes) - n + 1, 0)
    grams = np.full(size, 0x243F6A8885A308D3, dtype=np.uint64)
    for at in range(n):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + size])
    inside = owner[:size] == owner[n - 1 :] if size else np.zeros(0, bool)
    grams, owner = grams[inside], owner[:size][inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = [
        xxhash.xxh3_64_intdigest(hashes[begin[i] : begin[i] + counts[i]].tobytes()) for i in short
    ]
    grams = np.concatenate((grams, np.array(whole, dtype=np.uint64))).view(np.int64)
    owner = np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[first], np.bincount(owner[first], minlength=len(counts))


def entities_of(grams: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The hash that stands for each set."""
    digests = [
        xxhash.xxh3_64_intdigest(grams[b : b + c].tobytes()) for b, c in zip(starts_of(counts), counts)
    ]
    return pa.array(np.array(digests, dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Per row: key, entity (hash of the set), size, tokens to index, counts between cuts."""
    end = region_end(percent)

    def run(batch):
        grams, counts = shingle_sets(batch.column(1), n)
        owner = np.repeat(np.arange(len(counts)), counts)
        region = np.bincount(owner[grams < end], minlength=len(counts))
        lacking = region < counts - needed(percent, counts) + 1
        sent = (grams < end) | lacking[owner]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[sent], minlength=len(counts)))))
        cell = owner * CELLS + ((grams >> 58) + CELLS // 2)
        cells = np.bincount(cell, minlength=len(counts) * CELLS)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), entities_of(grams, counts), pa.array(counts, pa.int64()),
                pa.array(region, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams[sent])),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(len(counts) + 1) * CELLS, pa.int32()), pa.array(cells, pa.int32())
                ),
            ],
            names=["key", "entity", "n", "region", "tokens", "cells"],
        )

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run,
        f"key {kind}, entity long, n long, region long, tokens array<long>, cells array<int>",
    )


def _overlap(percent: int, a: str, b: str) -> Column:
    """Smallest number of common tokens of two sets of these sizes: ceil(t / (1 + t) (a + b))."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def _passes(percent: int) -> Column:
    """Length and positional filter on two rows of one token (n, pos and m, at)."""
    left = F.least(F.expr("n - pos"), F.expr("m - at"))
    return (
        F.expr(f"100 * n >= {percent} * m and 100 * m >= {percent} * n")
        & (left >= _overlap(percent, "n", "m"))
    )


def prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """Rows (token, entity, n, pos, copies): the tokens of each prefix that more than one set has.

    ``tokens``: (token, entity, n, region, copies); what is in the region comes first.
    """
    inside = F.col("token") < F.lit(region_end(percent))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    found = tokens.join(shared, "token").withColumn("inside", inside & (F.col("region") < F.col("n")))
    own = W.partitionBy("entity")
    ranked = found.select(
        "token", "entity", "n", "region", "copies", "inside",
        F.row_number().over(own.orderBy(F.desc("inside"), "sets", "token")).alias("rank"),
        F.sum(F.col("inside").cast("long")).over(own).alias("shared_inside"),
        F.count(F.lit(1)).over(own).alias("shared_all"),
    )
    # Tokens of a single set are the rarest: they stand before those of their part.
    single = F.expr("case when inside then region - shared_inside else n - shared_all end")
    return (
        ranked.withColumn("pos", F.col("rank") - 1 + single)
        .filter(F.expr(f"pos < n - ({percent} * n + 99) div 100 + 1"))
        .select("token", "entity", "n", "pos", "copies")
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows of tokens that several sets have, with the pivot of each token.

    The set with the fewest rarer tokens is the likeliest original of a group.
    """
    pivots = rows.groupBy("token").agg(
        F.min(F.struct("pos", -F.col("copies"), "entity"))["entity"].alias("pivot"), F.count(F.lit(1)).alias("k")
    )
    return rows.join(pivots.filter("k > 1"), "token")


def _stars(grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each set with one of its pivots, the likeliest."""
    centre = grouped.filter("entity = pivot").select(
        "token", F.col("entity").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at")
    )
    met = grouped.filter("entity <> pivot").join(centre, "token").filter(_passes(percent))
    return met.groupBy("entity").agg(F.min(F.struct("at", "other"))["other"].alias("other")).select(*_pair()).distinct()


def _classed(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their class and their pivot's."""
    own = labels.select(F.col("id").alias("entity"), F.col("label").alias("own"))
    main = labels.select(F.col("id").alias("pivot"), F.col("label").alias("main"))
    return (
        grouped.join(own, "entity", "left").join(main, "pivot", "left")
        .withColumn("own", F.coalesce("own", "entity")).withColumn("main", F.coalesce("main", "pivot"))
        .select("token", "entity", "n", "pos", "k", "own", "main")
    )


def _crossing(classed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different classes on one token: those outside the pivot's class with all others."""
    outside = classed.filter("own <> main").select(
        "token", F.col("entity").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"),
        F.col("own").alias("class"),
    )
    met = classed.join(outside, "token").filter(F.expr("own <> class")).filter(_passes(percent))
    return met.select(*_pair()).distinct()


def _pair():
    return F.least("entity", "other").alias("a"), F.greatest("entity", "other").alias("b")


def _suffix(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose counts between cuts allow the overlap that is needed."""
    one = sizes.select(F.col("entity").alias("a"), F.col("n").alias("n_a"), F.col("cells").alias("cells_a"))
    two = sizes.select(F.col("entity").alias("b"), F.col("n").alias("n_b"), F.col("cells").alias("cells_b"))
    apart = F.aggregate(
        F.zip_with("cells_a", "cells_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x
    )
    return (
        pairs.join(one, "a").join(two, "b")
        .filter(apart <= F.col("n_a") + F.col("n_b") - 2 * _overlap(percent, "n_a", "n_b"))
        .select("a", "b")
    )


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) with whether their sets are similar enough, from the texts."""
    one = texts.select(F.col("entity").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("entity").alias("b"), F.col("text").alias("text_b"))

    def run(batch):
        a, n_a = shingle_sets(batch.column(2), n)
        b, n_b = shingle_sets(batch.column(3), n)
        x, y, linked = starts_of(n_a), starts_of(n_b), []
        for at in range(batch.num_rows):
            common = len(
                np.intersect1d(a[x[at] : x[at] + n_a[at]], b[y[at] : y[at] + n_b[at]], assume_unique=True)
            )
            linked.append(100 * common >= percent * int(n_a[at] + n_b[at] - common))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
        )

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return map_batches(joined, run, "a long, b long, linked boolean")


def _texts(
    ids: DataFrame, marked: DataFrame, docs: DataFrame, key: str, text: str, n: int
) -> DataFrame:
    """One text for each entity, from the rows with the entity's smallest key."""
    of = marked.join(ids, "entity", "left_semi").groupBy("entity").agg(F.min("key").alias("key"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    joined = of.join(rows, F.col("key").eqNullSafe(F.col("k"))).select("entity", "text")

    def own(batch):  # keys may repeat
        grams, counts = shingle_sets(batch.column(1), n)
        return batch.filter(pc.equal(batch.column(0), entities_of(grams, counts)))

    return map_batches(joined, own, "entity long, text string").groupBy("entity").agg(
        F.first("text").alias("text")
    )


def ngram_components(
    docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: ``key``, ``n_shingles``, and ``component_id``, the smallest key it is linked to.

    Rows link when 100 * intersection >= percent * union of their n-gram sets.
    """
    marked = store(signatures(docs, key, text, n, percent), "ngram-sets")
    sets = marked.filter("n > 0")
    entities = sets.groupBy("entity").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "region", "tokens")]
    )
    tokens = entities.select("entity", "n", "region", "copies", F.explode("tokens").alias("token"))
    rows = _grouped(store(prefixes(tokens, percent), "ngram-prefixes"))

    stars = _plausible(_stars(rows, percent), marked, percent, "stars")
    texts = store(_texts(_ends(stars), marked, docs, key, text, n), "ngram-texts")
    first = store(_verified(stars, texts, n, percent), "ngram-links")
    labels = connected_components(first.filter("linked").select("a", "b"))

    # Where sets of several classes still meet.
    classed = store(_classed(rows, labels), "ngram-classes")
    mixed = classed.filter("own <> main").select("token", "k").distinct()
    few = classed.join(mixed.filter(F.col("k") <= FEW).select("token"), "token", "left_semi")
    many = classed.join(mixed.filter(F.col("k") > FEW).select("token"), "token", "left_semi")
    many = store(many.select("entity").distinct(), "ngram-many")
    known = first.select("a", "b")
    crossing = _plausible(_crossing(few, percent).join(known, ["a", "b"], "left_anti"), marked, percent, "few")
    texts = store(_texts(_ends(crossing).union(many).distinct(), marked, docs, key, text, n), "ngram-texts")
    # Sets of crowded tokens meet again on all their tokens, where each set's
    # own edits come first and the positional filter sees all of them.
    whole = map_batches(texts.join(many, "entity", "left_semi"), _all_tokens(n), "token long, entity long, n long")
    whole = whole.withColumn("region", F.col("n")).withColumn("copies", F.lit(1).cast("long"))
    whole = _grouped(store(prefixes(whole, percent), "ngram-whole"))
    stars = _plausible(_stars(whole, percent).join(known, ["a", "b"], "left_anti"), marked, percent, "deep-stars")
    again = first.union(store(_verified(stars, texts, n, percent), "ngram-links"))
    labels = connected_components(again.filter("linked").select("a", "b"))
    known = again.select("a", "b")
    deep = _crossing(_classed(whole, labels), percent).join(known, ["a", "b"], "left_anti")
    pairs = crossing.join(known, ["a", "b"], "left_anti").union(_plausible(deep, marked, percent, "many")).distinct()
    second = again.union(_verified(pairs, texts, n, percent))
    labels = connected_components(second.filter("linked").select("a", "b"))

    named = sets.select("key", "entity", "n").join(
        labels.withColumnRenamed("id", "entity"), "entity", "left"
    ).withColumn("label", F.coalesce("label", "entity"))
    smallest = named.groupBy("label").agg(F.min("key").alias("component_id"))
    linked = named.join(smallest, "label").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id"
    )
    alone = marked.filter("n = 0").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id")
    )
    return linked.union(alone)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("entity")).distinct()


def _plausible(pairs: DataFrame, marked: DataFrame, percent: int, name: str) -> DataFrame:
    """Pairs that the suffix filter leaves."""
    pairs = store(pairs, f"ngram-{name}")
    sizes = marked.join(_ends(pairs), "entity", "left_semi").groupBy("entity").agg(
        F.first("n").alias("n"), F.first("cells").alias("cells")
    )
    return store(_suffix(pairs, sizes, percent), f"ngram-{name}-left")


def _all_tokens(n: int):
    def run(batch):
        grams, counts = shingle_sets(batch.column(1), n)
        owner = np.repeat(np.arange(len(counts)), counts)
        entity = np.asarray(batch.column(0))
        arrays = [pa.array(a) for a in (grams, entity[owner], counts[owner].astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["token", "entity", "n"])

    return run
