"""Words, hashes and small plan helpers shared by the operators.

A word is a maximal run of characters outside ``\\x20`` and ``\\x09-\\x0D``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

Batch = pa.RecordBatch

_kept: list[tuple] = []


def kept(key: tuple, make: Callable[[], object]):
    """What this worker keeps from task to task: the last thing asked for, and no other.

    Workers outlive stages, so what each operator remembers would add up.
    """
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, make()))
    return _kept[0][1]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the number of each text's words (null: 0)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists))
    kept = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not kept.all():
        words, owner = words.filter(pa.array(kept)), owner[kept]
    return words, np.bincount(owner, minlength=len(lists))


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes; each distinct word of a batch is hashed once."""
    coded = words.dictionary_encode()
    table = np.array(
        [xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.binary()).to_pylist()],
        dtype=np.uint64,
    )
    return table[np.asarray(coded.indices)] if len(words) else np.empty(0, np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each group begins when groups of these sizes follow one another."""
    return np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64)


def map_batches(frame: DataFrame, function: Callable[[Batch], Batch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch; what it keeps is bounded by the batch."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return frame.mapInArrow(run, schema)


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of a key written as text, modulo a number of buckets; null keys are in none."""
    return F.crc32(key.cast("string").cast("binary")) % buckets


def sampled(key: Column, rate: float, seed: int = 17) -> Column:
    """A repeatable choice of about this share of the keys."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
