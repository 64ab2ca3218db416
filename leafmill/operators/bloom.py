"""Bloom filters as tables: which rows may have one of many keys, told where they are read.

A filter is a table of blocks of ``WORDS`` 64-bit words; a key sets ``PROBES``
bits of the one block its hash names.  It is built by aggregation and broadcast:
never more than ``MAX_BLOCKS`` blocks of 4 KB, 64 MB, whatever the number of
keys; more keys than about 30 million only let more rows through.  So rows are cut before any
shuffle, and whoever needs the exact answer joins what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 512
PROBES = 4
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 14

_BLOCK = "_bloom_block"
_BITS = "_bloom_words"


def n_blocks(n_keys: int) -> int:
    """Blocks for so many keys at about 16 bits each: one key in several hundred is let through by chance."""
    return min(MAX_BLOCKS, max(1, -(-n_keys * BITS_PER_KEY // (WORDS * 64))))


def _block(columns: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def _places(columns: Sequence[str]) -> list[Column]:
    """The bits of a key in its block."""
    second = F.xxhash64(F.lit(1), *columns)
    each = F.lit(WORDS * 64 - 1)
    return [F.shiftrightunsigned(second, 15 * i).bitwiseAND(each).cast("int") for i in range(PROBES)]


def bloom_filter(keys: DataFrame, columns: Sequence[str], blocks: int) -> DataFrame:
    """The filter of the keys in these columns, one row per block in use."""
    bits = keys.select(
        _block(columns, blocks).alias(_BLOCK), F.explode(F.array(*_places(columns))).alias("place")
    ).select(
        _BLOCK, F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, place & 63)").alias("bit")
    )
    words = bits.groupBy(_BLOCK, "word").agg(F.bit_or("bit").alias("bits"))
    table = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(WORDS - 1)),
        lambda i: F.coalesce(F.try_element_at("table", i), F.lit(0).cast("long")),
    )
    return words.groupBy(_BLOCK).agg(table.alias("table")).select(_BLOCK, filled.alias(_BITS))


def possible(rows: DataFrame, columns: Sequence[str], bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be in the filter: all that are, and few others."""
    hit = F.lit(True)
    for place in _places(columns):
        word = F.get(_BITS, F.shiftright(place, 6))
        hit = hit & (F.getbit(word, place.bitwiseAND(F.lit(63))) == 1)
    found = rows.withColumn(_BLOCK, _block(columns, blocks)).join(F.broadcast(bloom), _BLOCK).filter(hit)
    return found.drop(_BLOCK, _BITS)
