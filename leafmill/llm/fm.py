"""Quality scores by a factorisation machine.

A text is a sparse vector of hashed words (log counts, length 1) and statistics
of its structure: shares of kinds of characters, word lengths, repetition, size.
The score is the logistic function of

    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),

so all pairs interact through ``FACTORS`` numbers per feature at linear cost.
Training takes rounds: every task starts from the same parameters, goes once
over its stored part of the sample, and the driver averages what comes back,
which is as large as the model and one part of it per task.

``fit`` takes at most about ``max_rows`` labelled rows, chosen by a hash of the
key; everything is scored.

Cases: null text is empty; an empty text is scored by its (zero) statistics;
labels that are null are not learned from; without labels every score is 0.5;
repeated rows get equal scores; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import hash_words, map_batches, sampled, split_words, starts_of
from leafmill.session import store

WORDS = 1 << 15
FACTORS = 8
PARTS, ROUNDS, BATCH = 6, 12, 32
RATE, DECAY = 0.1, 1e-5

# Kinds of bytes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line feed, 5 sentence mark, 6 symbol, 7 not ASCII
_KIND = np.full(256, 6, np.uint8)
_KIND[128:] = 7
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 3, 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
KINDS = 8
STATISTICS = KINDS + 7


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values of all texts in a row, and how many each text has."""
    texts = pc.fill_null(texts, "")
    words, counts = split_words(texts)
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    hashes = hash_words(words)
    key = owner * WORDS + (hashes & np.uint64(WORDS - 1)).astype(np.int64)
    again = np.bincount(owner[1:], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), n)
    found, times = np.unique(key, return_counts=True)
    whose = found // WORDS
    value = np.log1p(times)
    length = np.sqrt(np.bincount(whose, value**2, n))
    value = value / length[whose] if len(whose) else value
    distinct = np.bincount(whose, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, whose, times)
    stats = np.zeros((n, STATISTICS))
    for at, text in enumerate(texts):
        data = np.frombuffer(text.as_buffer(), np.uint8)
        stats[at, :KINDS] = np.bincount(_KIND[data], minlength=KINDS) / max(len(data), 1)
        stats[at, KINDS] = np.log1p(len(data)) / 15
    some = np.maximum(counts, 1)
    sizes = np.bincount(owner, np.asarray(pc.binary_length(words)), n)
    stats[:, KINDS + 1 :] = np.stack(
        [np.minimum(sizes / some / 10, 3), distinct / some, np.sqrt(top / some), np.log1p(counts) / 12, counts > 0, np.sqrt(again / some)],
        axis=1,
    )
    stats[:, :KINDS] = np.sqrt(stats[:, :KINDS])
    index = np.concatenate((found % WORDS, np.tile(WORDS + np.arange(STATISTICS), n)))
    value = np.concatenate((value, stats.reshape(-1)))
    whose = np.concatenate((whose, np.repeat(np.arange(n), STATISTICS)))
    order = np.argsort(whose, kind="stable")
    return index[order].astype(np.int32), value[order].astype(np.float32), np.bincount(whose, minlength=n)


@dataclass
class Machine:
    """``weights``: feature x (1 + FACTORS), linear weight first; ``bias``."""

    weights: np.ndarray
    bias: float

    @classmethod
    def new(cls) -> Machine:
        weights = np.random.default_rng(7).normal(0, 0.05, (WORDS + STATISTICS, 1 + FACTORS)).astype(np.float32)
        weights[:, 0] = 0
        return cls(weights, 0.0)

    def raw(self, index: np.ndarray, value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What goes into the logistic function, and the sums of factors."""
        if not len(index):
            return np.full(len(counts), self.bias), np.zeros((len(counts), FACTORS))
        taken = self.weights[index] * value[:, None]
        begin = starts_of(counts)
        sums = np.add.reduceat(taken, begin)
        squares = np.add.reduceat(taken[:, 1:] ** 2, begin)
        return self.bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1), sums[:, 1:]

    def scores(self, index, value, counts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, value, counts)[0].astype(float), -30, 30)))

    def learn(self, rows: list[tuple], squares: np.ndarray) -> None:
        """One pass over rows (label, index, value) with AdaGrad steps."""
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            label = np.array([r[0] for r in some], dtype=np.float32)
            index = np.concatenate([r[1] for r in some])
            value = np.concatenate([r[2] for r in some])
            counts = np.array([len(r[1]) for r in some])
            raw, sums = self.raw(index, value, counts)
            miss = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label
            owner = np.repeat(np.arange(len(some)), counts)
            x, error = value[:, None], miss[owner][:, None].astype(np.float32)
            slope = np.hstack((error * x, error * (x * sums[owner] - self.weights[index, 1:] * x**2)))
            used, where = np.unique(index, return_inverse=True)
            step = np.zeros((len(used), 1 + FACTORS), np.float32)
            np.add.at(step, where, slope)
            step = step / len(some) + DECAY * self.weights[used]
            squares[used] += step**2
            self.weights[used] -= RATE * step / np.sqrt(squares[used])
            self.bias -= 0.05 * float(miss.mean())


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "quality", max_rows: int = 12_000,
) -> Machine:
    """Learn from documents with labels; both tables are joined by the key."""
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("label")).filter(
        "label is not null and __key is not null"
    )
    rate = min(1.0, max_rows / max(1, known.count()))
    # Bounded by ``max_rows``.
    chosen = F.broadcast(known.filter(sampled(F.col("__key"), rate)))
    picked = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(chosen, "__key")

    def prepare(batch):
        index, value, counts = features(batch.column(0))
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(1), batch.column(2),
                pa.ListArray.from_arrays(offsets, pa.array(index)), pa.ListArray.from_arrays(offsets, pa.array(value)),
            ],
            names=["label", "turn", "index", "value"],
        )

    order = F.xxhash64("__key", F.lit(29)).alias("turn")
    rows = store(
        map_batches(picked.select("text", "label", order), prepare, "label int, turn long, index array<int>, value array<float>")
        .repartition(PARTS, F.pmod("turn", F.lit(1 << 20))).sortWithinPartitions("turn"),
        "fm-rows",
    )
    machine = Machine.new()
    part = F.pmod("turn", F.lit(PARTS)).alias("part")
    for _ in range(ROUNDS):
        parts = rows.withColumn("part", part).groupBy("part").applyInArrow(
            _learner(machine), "n long, bias double, weights binary"
        ).collect()
        if not parts:
            return Machine(np.zeros_like(machine.weights), 0.0)
        total = sum(p["n"] for p in parts)
        weights = sum(
            np.frombuffer(p["weights"], np.float32).reshape(machine.weights.shape) * (p["n"] / total) for p in parts
        )
        machine = Machine(weights.astype(np.float32), sum(p["bias"] * p["n"] for p in parts) / total)
    return machine


def _learner(start: Machine):
    def learn(table: pa.Table) -> pa.Table:
        own = Machine(start.weights.copy(), start.bias)
        table = table.sort_by("turn")
        rows = [
            (l, np.asarray(i.values), np.asarray(v.values))
            for l, i, v in zip(table["label"].to_pylist(), table["index"], table["value"])
        ]
        own.learn(rows, np.full(own.weights.shape, 1e-2, np.float32))
        return pa.table({
            "n": pa.array([len(rows)], pa.int64()), "bias": pa.array([float(own.bias)]),
            "weights": pa.array([own.weights.tobytes()], pa.binary()),
        })

    return learn


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score (0 to 1)."""

    def run(batch):
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(machine.scores(*features(batch.column(1))))], names=["key", "score"]
        )

    kind = docs.schema[key].dataType.simpleString()
    scored = map_batches(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, score double"
    )
    return scored.withColumnRenamed("key", key)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labelled rows that are not held out, then score every row."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    machine = fit(docs, labels.filter(~out))
    return score(docs, machine).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
