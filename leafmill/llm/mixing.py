"""Mixing sources to target weights by cube-method balanced sampling.

A source's target divided by its size says how often each of its documents is
wanted.  The whole part is given to all; the fraction is the probability of one
more copy.  The cube method turns probabilities into choices: three undecided
documents at a time are moved along the one direction that changes neither
their expected tokens nor their expected number, by a random step that keeps
every expectation, until one is decided.  At most two per block of a source are
left; they meet in the next round's blocks.  The last two of a source are
landed on the choice that comes nearest to its tokens; as one of them may be
long, ``HELPERS`` documents of other sizes are decided again with them.

A block holds about ``BLOCK`` documents of a source, chosen by a hash, so a
source of any size is spread over tasks.  Large documents are decided first.
Random steps are drawn from the block's name: reruns agree.

Cases: null text counts no words; a null source is a source of its own, the
last; a source without words has target 0; repeated rows are decided one by
one; without rows there are no targets.  Further columns are not read by
``mix``; ``mixed_documents`` keeps all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import WORD
from leafmill.session import store

BLOCK = 8192
# Decided documents of a source's first block that the landing may still turn round.
HELPERS = 10


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row per source: rows, source_size, target.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all sizes; no target exceeds ``most`` times its source, what
    is above goes to the others by weight.  That is one water level: the target
    is the smaller of the limit and weight times level.  Its windows run over
    one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    wanted = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ).withColumn("limit", F.col("source_size") * F.lit(most))
    by_level = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    onward = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    wanted = wanted.withColumn("try", level)
    fits = F.when(F.col("try") <= F.col("limit") / F.col("weight"), F.col("try"))
    return wanted.withColumn("level", F.max(fits).over(everything)).select(
        "source", "rows", "source_size",
        F.coalesce(F.least("limit", F.col("weight") * F.col("level")), F.col("limit")).alias("target"),
    )


def fly(size: np.ndarray, chance: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Move chances to 0 or 1, keeping sum(chance) and sum(chance * size); at most two stay between."""
    chance, sizes = chance.astype(float).tolist(), size.tolist()
    draws = random.random(len(sizes)).tolist()
    open_, draw = [], 0
    for new in range(len(sizes)):
        if 0.0 < chance[new] < 1.0:
            open_.append(new)
        while len(open_) == 3:
            a, b, c = open_
            along = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(along):
                along = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for at, step in zip(open_, along):
                if step:
                    room = ((1.0 - chance[at]) / step, chance[at] / step)
                    up = min(up, room[0] if step > 0 else -room[1])
                    down = min(down, room[1] if step > 0 else -room[0])
            move = up if draws[draw] * (up + down) < down else -down
            draw += 1
            for at, step in zip(open_, along):
                if step:
                    to = chance[at] + move * step
                    chance[at] = 0.0 if to < 1e-9 else 1.0 if to > 1 - 1e-9 else to
            open_ = [at for at in open_ if 0.0 < chance[at] < 1.0]
    return np.array(chance)


def land(size: np.ndarray, chance: np.ndarray, wanted: float) -> np.ndarray:
    """Decide what is left so that the chosen sizes come nearest to those wanted.

    Open units get either value; decided ones (the block's helpers) may be
    turned round where that brings the sum nearer.
    """
    open_ = (chance > 0) & (chance < 1)
    n, scale = len(size), max(size.mean(), 1.0)
    choice = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    turned = np.where(open_, 0, choice != chance).sum(1)
    miss = np.abs(choice @ size - wanted) / scale + 0.01 * np.abs(choice.sum(1) - chance.sum()) + 0.001 * turned
    return choice[np.argmin(miss)].astype(float)


def _round(units: DataFrame, seed: int, turn: int, last: bool) -> DataFrame:
    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "__rid", "__copy"], ascending=[False, True, True], ignore_index=True)
        source = group["source"].iloc[0]
        name = f"{seed}/{turn}/{source!r}/{group['__block'].iloc[0]}"
        random = np.random.default_rng(xxhash.xxh64_intdigest(name))
        size, before = group["size"].to_numpy(dtype=float), group["chance"].to_numpy(dtype=float)
        chance = fly(size, before, random)
        held = (chance > 0) & (chance < 1)
        if last:
            helpers = np.flatnonzero(~held & group["__held"])[:HELPERS]
            some = np.sort(np.concatenate((np.flatnonzero(held), helpers)))
            chance[some] = land(size[some], chance[some], (size[some] * chance[some]).sum())
            held[:] = False
        elif turn == 0 and group["__block"].iloc[0] == 0:
            flown = np.flatnonzero(~held & (before > 0) & (before < 1))
            held[flown[np.linspace(0, len(flown) - 1, min(HELPERS, len(flown))).astype(int)]] = True
        elif turn:
            held |= group["__held"].to_numpy() & ~((before > 0) & (before < 1))
        return group.assign(chance=chance, __held=held)

    return units.groupBy("source", "__block").applyInPandas(decide, units.schema)


def decide_copies(units: DataFrame, seed: int = 1) -> DataFrame:
    """Units (source, size, chance, rows, __rid, __copy, ...) with every chance moved to 0 or 1."""
    spread = F.ceil(F.col("rows") / BLOCK).cast("long")
    units = units.withColumn("__block", F.pmod(F.xxhash64("__rid", "__copy", F.lit(seed)), spread))
    flown = store(_round(units.withColumn("__held", F.lit(False)), seed, 0, False), "mixing")
    settled, turn = [flown.filter("not __held")], 1
    left = flown.filter("__held")
    blocks = units.agg(F.max(F.ceil(F.col("rows") / BLOCK))).first()[0] or 1
    while blocks > BLOCK // 4:
        left = left.withColumn("__block", F.expr(f"__block div {BLOCK // 4}"))
        flown = store(_round(left, seed, turn, False), "mixing")
        settled.append(flown.filter("not __held"))
        left, turn = flown.filter("__held"), turn + 1
        blocks = -(-blocks // (BLOCK // 4))
    settled.append(_round(left.withColumn("__block", F.lit(0).cast("long")), seed, turn, True))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def _units(rows: DataFrame, weights, share, most) -> DataFrame:
    """Rows (source, size, __rid, ...) with source_size, target, base copies and the chance of one more."""
    targets = source_targets(rows, weights, share, most).withColumnRenamed("source", "__source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        rows.join(targets, F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("base", F.floor(wanted + 1e-12))
        .withColumn("chance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), wanted - F.col("base"))))
        .withColumn("chance", F.when(F.col("chance") < 1e-9, 0.0).otherwise(F.col("chance")))
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1,
) -> DataFrame:
    """Per row: key, size, source_size, target, copies, taken (words, repeats counted)."""
    rows = store(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"),
            F.xxhash64(key, text).alias("__rid"), F.lit(0).alias("__copy"),
        ), "mixing-sizes",
    )
    decided = decide_copies(_units(rows, weights, share, most), seed)
    copies = F.col("base") + F.col("chance").cast("long")
    return decided.select(
        F.col("key").alias(key), "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    text: str = "text", source: str = "source", seed: int = 1,
) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns it had.

    Rows are known again by a hash of all their columns and, among equal rows,
    by their number.
    """
    marked = docs.withColumn("__rid", F.xxhash64(*docs.columns))
    numbered = marked.withColumn(
        "__copy", F.row_number().over(W.partitionBy("__rid").orderBy("__rid"))
    )
    rows = store(
        numbered.select(F.col(source).alias("source"), count_words(F.col(text)).alias("size"), "__rid", "__copy"),
        "mixing-sizes",
    )
    decided = decide_copies(_units(rows, weights, share, most), seed)
    copies = (F.col("base") + F.col("chance").cast("long")).cast("int")
    chosen = decided.select("__rid", "__copy", copies.alias("__copies")).filter("__copies > 0")
    return (
        numbered.join(chosen, ["__rid", "__copy"])
        .withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .select(*docs.columns)
    )
