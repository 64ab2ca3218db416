"""Token files coded with a static range asymmetric numeral system.

One frequency table, counted over all ids and scaled to 2^22, serves all files.
A file is a Parquet part whose rows are independent blocks of whole documents.
A block codes its ids on ``LANES`` interleaved states of 64 bits that share one
stream of 32-bit words.  Every ``STEPS`` steps it keeps the states and the place
in the stream, so that the parts between two checkpoints are decoded at the
same time; its checksum is tested before decoding, its final states after.

Layout of a payload, little-endian: header (see ``HEADER``), places of the
checkpoints, states of the checkpoints, words.

Cases: null and empty texts have the end id only; rows with equal keys stand
next to each other; null keys come first; further columns are not read; of an
empty table the files have no blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.tokens import encode, id_kind, wide
from leafmill.session import new_folder, store

HEADER = struct.Struct("<4sHHIIQ")  # magic, version, lanes, ids, checkpoints, words
MAGIC, VERSION = b"LRNS", 1
BITS, LANES, STEPS = 22, 256, 512
LOW = np.uint64(1 << 31)  # a state never falls below this between two ids
BLOCK_IDS = 1 << 20


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies that add up to 2^BITS; what occurs keeps at least 1."""
    counts = counts.astype(np.float64)
    used = counts > 0
    if not used.any():
        return np.zeros(len(counts), np.uint64)
    spare = (1 << BITS) - int(used.sum())
    shares = np.floor(counts * spare / counts.sum()).astype(np.int64) + used
    shares[np.argmax(counts)] += (1 << BITS) - shares.sum()
    return shares.astype(np.uint64)


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.frequency = frequencies.astype(np.uint64)
        self.below = np.concatenate(([0], np.cumsum(self.frequency)))[:-1].astype(np.uint64)
        self._symbols = None

    @property
    def symbols(self) -> np.ndarray:
        """Which id owns each of the 2^BITS slots."""
        if self._symbols is None:
            self._symbols = np.repeat(
                np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64)
            )
        return self._symbols

    def encode(self, ids: np.ndarray) -> bytes:
        state = np.full(LANES, LOW)
        frequency, below = self.frequency[ids], self.below[ids]
        limit = frequency << np.uint64(63 - BITS)
        # x // f * 2^BITS + x % f is x + x // f * (2^BITS - f)
        rest = np.uint64(1 << BITS) - frequency
        words: list[np.ndarray] = []
        states, places, written = [], [], 0
        for step in range(-(-len(ids) // LANES) - 1, -1, -1):
            now = slice(step * LANES, (step + 1) * LANES)
            f = frequency[now]
            x = state[: len(f)]
            over = np.flatnonzero(x >= limit[now])
            if len(over):
                words.append(x[over])
                written += len(over)
                x[over] >>= np.uint64(32)
            whole = x // f
            whole *= rest[now]
            x += whole
            x += below[now]
            if step % STEPS == 0:
                states.append(state.copy())
                places.append(written)
        stream = (np.concatenate(words[::-1]) & np.uint64(0xFFFFFFFF)).astype("<u4") if words else np.empty(0, "<u4")
        place = len(stream) - np.array(places[::-1], dtype="<u8")
        head = HEADER.pack(MAGIC, VERSION, LANES, len(ids), len(place), len(stream))
        kept = b"".join(s.astype("<u8").tobytes() for s in states[::-1])
        return head + place.astype("<u8").tobytes() + kept + stream.tobytes()

    def decode(self, payload: bytes) -> np.ndarray:
        """All ids of a block; every part between checkpoints at the same time."""
        magic, version, lanes, n, parts, n_words = HEADER.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of this format")
        at = HEADER.size
        place = np.frombuffer(payload, "<u8", parts, at).astype(np.int64)
        state = np.frombuffer(payload, "<u8", parts * lanes, at + 8 * parts).reshape(parts, lanes).copy()
        words = np.frombuffer(payload, "<u4", n_words, at + 8 * parts * (lanes + 1)).astype(np.uint64)
        words = np.append(words, np.uint64(0))
        out = np.zeros((parts, STEPS * lanes), np.uint32)
        size = np.full(parts, STEPS * lanes)
        if parts:
            size[-1] = n - (parts - 1) * STEPS * lanes
        for step in range(-(-int(size.max(initial=0)) // lanes)):
            left = size - step * lanes  # of the last part, the end comes early
            rows = parts if left[-1] > 0 else parts - 1
            x = state[:rows]
            slot = x & np.uint64((1 << BITS) - 1)
            found = self.symbols[slot]
            new = self.frequency[found] * (x >> np.uint64(BITS)) + slot - self.below[found]
            under = new < LOW
            if left[-1] < lanes and rows == parts:
                ended = np.arange(lanes) >= left[-1]
                new[-1, ended] = x[-1, ended]
                under[-1, ended] = False
            turn = np.cumsum(under, axis=1)
            index = np.where(under, place[:rows, None] + turn - 1, n_words)
            state[:rows] = np.where(under, (new << np.uint64(32)) | words[index], new)
            place[:rows] += turn[:, -1]
            out[:rows, step * lanes : (step + 1) * lanes] = found
        if parts and (state[-1] != LOW).any():
            raise ValueError("a block does not end as it began")
        return out.reshape(-1)[:n]


def _counts(encoded: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """How often each id occurs in all texts: one number per id of the vocabulary."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "k"])

    out = np.zeros(size, np.int64)
    for row in encoded.select("ids").mapInArrow(run, "id long, k long").groupBy("id").agg(F.sum("k").alias("k")).collect():
        out[row["id"]] = row["k"]
    return out


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> None:
    """Write all ids, in order of the key, below ``folder``: ``blocks`` and ``frequencies``."""
    spark = docs.sparkSession
    kind = id_kind(tokenizer)
    encoded = store(encode(docs, tokenizer, key, text, end_id), "token-ids")
    size = 1 << (8 * kind.itemsize if kind.itemsize == 2 else 18)
    frequencies = scaled(_counts(encoded, kind, size))
    table = [(int(i), int(frequencies[i])) for i in np.flatnonzero(frequencies)]
    spark.createDataFrame(table, "id int, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    key_type = encoded.schema["key"].dataType.simpleString()

    def blocks(batches):
        coder, shard, block, before = Coder(frequencies), TaskContext.get().partitionId(), 0, 0
        keys, parts, gathered = [], [], 0

        def close():
            ids = np.concatenate(parts)
            payload = coder.encode(ids)
            row = [[shard], [block], [before], [len(ids)], [keys], [[len(p) for p in parts]], [payload], [zlib.crc32(payload)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, fields)], schema=fields)

        fields = None
        for batch in batches:
            fields = fields or pa.schema([
                ("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
                ("keys", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())),
                ("payload", pa.binary()), ("crc32", pa.int64()),
            ])
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                keys.append(name)
                parts.append(np.frombuffer(ids.as_py(), kind))
                gathered += len(parts[-1])
                if gathered >= BLOCK_IDS:
                    yield close()
                    block, before = block + 1, before + gathered
                    keys, parts, gathered = [], [], 0
        if parts:
            yield close()

    ordered = encoded.repartitionByRange("key", "n").sortWithinPartitions("key", "n", "ids")
    ordered.mapInArrow(
        blocks,
        f"shard int, block int, before long, n_ids long, keys array<{key_type}>, lengths array<long>,"
        " payload binary, crc32 long",
    ).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark, folder: str) -> DataFrame:
    """Per document: key, start (ids before it), n_tokens, ids (32-bit numbers), from the files alone."""
    rows = spark.read.parquet(f"{folder}/frequencies").collect()  # bounded by the vocabulary
    frequencies = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint64)
    for row in rows:
        frequencies[row["id"]] = row["frequency"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row per file; their number is that of the writing tasks.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    ahead = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    placed = blocks.join(shards, "shard").select(
        (F.col("ahead") + F.col("before")).alias("start"), "keys", "lengths", "payload", "crc32"
    )
    key_type = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        coder = Coder(frequencies)
        for batch in batches:
            for at in range(batch.num_rows):
                payload = batch.column(3)[at].as_py()
                if zlib.crc32(payload) != batch.column(4)[at].as_py():
                    raise ValueError("a block's checksum differs")
                ids = coder.decode(payload)
                lengths = np.asarray(batch.column(2)[at].values)
                begin = np.concatenate(([0], np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1)[at].values, pa.array(begin[:-1] + batch.column(0)[at].as_py()),
                        pa.array(lengths),
                        pa.array([wide(ids[b:e]) for b, e in zip(begin[:-1], begin[1:])], pa.binary()),
                    ],
                    names=["key", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(run, f"key {key_type}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = new_folder(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, folder, end_id)
    return read_token_files(docs.sparkSession, folder)
