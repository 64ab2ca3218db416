"""Removal of repeated passages by recompression.

Every text is parsed by the same local rules: runs of equal symbols, then
pairs of a *left* symbol before a *right* one, become new symbols, round after
round.  A symbol's name is a hash of what it is made of, so equal passages get
equal names everywhere without a shared dictionary, and names are compared in
Spark.  Whether a symbol is left or right is a bit of its name, so a decision
depends on the two symbols only: inside a window, all symbols but those at its
edges are the same wherever the window stands.  This gives three steps.

1. Of the symbols of level ``DEEP`` whose form does not depend on what surrounds
   the window, each window takes the ``RUN`` neighbours with the smallest hash
   (of its words, where it has fewer symbols), so that windows beside each other
   mostly take the same.  The names of these and of all long symbols are
   counted.  A window that occurs twice has a run that occurs twice; a long
   symbol that occurs twice proves its windows.
2. The windows that are neither excluded nor proven are counted by two 64-bit
   hashes of their words; those of a repeated long symbol are counted once, in
   one of its rows, so that a window elsewhere can meet them.
3. Words under a repeated window are removed.

Only what occurs *once* is sent back to its row, never the members of a group,
so nothing grows with the size of a group of copies: counts are combined before
they move, and a symbol or window with one occurrence names one row.

Cases: null, empty and blank texts have no words and come back as ''; texts
below the window's length stay; repeated rows repeat each other; rows with one
key and different texts are separate.  Further columns are kept; those named
like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import hash_words, map_batches, mix, split_words, starts_of
from leafmill.session import store

RESULTS = ["kept_text", "n_words", "n_removed"]
ROUNDS = 22
# Rounds that begin with runs: each costs every window a symbol at both ends.
RUN_ROUNDS = (0, 5, 10, 15)
# A window takes a run of so many symbols of this level.
RUN, DEEP = 6, 3
# A long symbol has at least so many windows' lengths.
LONG = 2
OWNER_SHIFT = 42
FACTOR = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.uint64((1 << 32) - 1)
# An odd number for each level.
_SIDES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
# The first so many bytes of eight.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Parse:
    """The symbols of a batch of texts.

    ``places`` and ``names`` hold the runs of symbols that windows take, each
    once, and ``which`` the number of each window's; ``long_*`` the places,
    names and ends of long symbols.  A place is (first word in its text, level,
    long or not) in one number, in ``places`` marked with its row.
    """

    def __init__(self, texts: pa.Array, window: int):
        self.words, self.counts = split_words(texts)
        self.first = starts_of(self.counts)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.hashes = _word_names(self.words)
        spread = np.maximum(self.counts - window + 1, 0)
        #: where each window begins, as an index of words, and whose it is
        self.whose = np.repeat(np.arange(len(self.counts)), spread)
        self.start = np.arange(spread.sum()) - np.repeat(starts_of(spread), spread) + self.first[self.whose]
        self.window = window
        self.run = min(RUN, window)
        self._parse()

    @property
    def code(self) -> np.ndarray:
        """The place in its text of what each window takes."""
        return (self.places & ((1 << OWNER_SHIFT) - 1))[self.which]

    def _place(self, begin: np.ndarray, level: int, long: int) -> np.ndarray:
        return (((begin - self.first[self.owner[begin]]) * 64 + level) * 2 + long).astype(np.int64)

    def _parse(self) -> None:
        symbols, begin, own = self.hashes, np.arange(len(self.hashes)), self.owner
        # What is the same wherever the window stands: symbols from ``low``, below ``stop``.
        low, stop = self.start, self.start + self.window
        longs: list[tuple] = []
        level = 0
        for turn in range(ROUNDS):
            for runs in (True, False) if turn in RUN_ROUNDS else (False,):
                if level == DEEP:
                    self._take(symbols, begin, low, stop)
                level += 1
                if not len(symbols):
                    continue
                beside = own[1:] == own[:-1]
                if runs:
                    joined = beside & (symbols[1:] == symbols[:-1])
                else:
                    right = (symbols ^ symbols << np.uint64(32)) * _SIDES[level] >> np.uint64(63) == 1
                    joined = beside & ~right[:-1] & right[1:]
                heads = np.append(True, ~joined)
                if level <= DEEP:
                    at = np.append(np.cumsum(heads) - 1, heads.sum())
                    if runs:
                        low, stop = np.minimum(at[low] + 1, at[-1]), at[np.maximum(stop - 1, 0)]
                    else:
                        # A first right symbol or a last left one may belong to a pair with one outside.
                        low = at[low + np.append(right, False)[low]]
                        stop = at[stop - np.append(~right, False)[stop - 1]]
                kept = np.flatnonzero(heads)
                length = np.diff(np.append(kept, len(symbols)))
                merged = np.flatnonzero(length > 1)
                old, symbols = symbols, symbols[kept]
                if runs:
                    symbols[merged] = mix(symbols[merged] ^ mix(length[merged].astype(np.uint64)))
                else:
                    symbols[merged] = mix(symbols[merged] * FACTOR + old[kept[merged] + 1])
                begin, own = begin[kept], own[kept]
                # The last symbol of a text ends with it: texts follow one another.
                ends = np.append(begin[1:], len(self.hashes))
                big = merged[(ends - begin)[merged] >= LONG * self.window]
                longs.append((own[big], self._place(begin[big], level, 1), symbols[big], begin[big], ends[big]))
        columns = [np.concatenate(c) for c in zip(*longs)] if longs else [np.empty(0, np.int64)] * 5
        self.long_owner, self.long_code, self.long_name, self.long_begin, self.long_end = columns

    def _take(self, symbols: np.ndarray, begin: np.ndarray, low: np.ndarray, stop: np.ndarray) -> None:
        """Each window takes a run of the symbols of its inside, of its words where those are too few."""
        code, name = np.empty(len(low), np.int64), np.empty(len(low), np.uint64)
        deep = stop - low >= self.run
        flat = ~deep
        if deep.any():
            at, name[deep] = _least_runs(symbols, low[deep], stop[deep], self.run)
            code[deep] = self._place(begin[at], DEEP, 0)
        if flat.any():
            at, name[flat] = _least_runs(self.hashes, self.start[flat], self.start[flat] + self.window, self.run)
            code[flat] = self._place(at, 0, 0)
        # Neighbours mostly take the same.
        code |= self.whose << OWNER_SHIFT
        new = np.append(True, code[1:] != code[:-1]) if len(code) else np.empty(0, bool)
        self.places, one, same = np.unique(code[new], return_index=True, return_inverse=True)
        self.which = same[np.cumsum(new) - 1]
        # Equal runs of words and of symbols that are words have different names.
        self.names = mix(name[new][one] + (self.places >> 1 & 63).astype(np.uint64))

    def keys(self) -> list[np.ndarray]:
        """Two hashes of each window's words."""
        size = len(self.hashes) + 1
        out = []
        for base, hashes in ((0xB492B66FBE98F273, self.hashes), (0x9AE16A3B2F90404F, mix(~self.hashes))):
            inverse = pow(base, -1, 1 << 64)
            up = np.cumprod(np.full(size, base, np.uint64)) if size else None
            down = np.cumprod(np.full(size, inverse, np.uint64))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * down[:-1], dtype=np.uint64)))
            out.append(((sums[self.start + self.window] - sums[self.start]) * up[self.start]).view(np.int64))
        return out

    def open(self, unique: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which windows are proven to repeat, and which are still to be counted.

        ``unique``: for each text, the places of symbols that occur once.
        """
        lone = np.sort(_owned(unique))
        seen_once = _in(lone, self.places)[self.which]
        proven = self._inside(~_in(lone, (self.long_owner << OWNER_SHIFT) | self.long_code))
        return proven, ~proven & ~seen_once

    def leading(self, leads: pa.Array) -> np.ndarray:
        """Windows of the long symbols that this text stands for; ``leads``: their names by text."""
        leads = pc.fill_null(leads, pa.scalar([], leads.type))
        owner = np.repeat(np.arange(len(leads)), np.asarray(pc.list_value_length(leads)))
        names = np.asarray(leads.flatten()).view(np.uint64)
        wanted = np.sort(mix(names ^ mix(owner.astype(np.uint64))))
        return self._inside(_in(wanted, mix(self.long_name ^ mix(self.long_owner.astype(np.uint64)))))

    def _inside(self, chosen: np.ndarray) -> np.ndarray:
        """Windows inside one of the chosen long symbols."""
        size = len(self.hashes) + 1
        last = np.bincount(self.long_end[chosen] - self.window + 1, minlength=size)
        return np.cumsum(np.bincount(self.long_begin[chosen], minlength=size) - last)[self.start] > 0


def _word_names(words: pa.Array) -> np.ndarray:
    """A hash of each word; those of at most 16 bytes are read as two numbers, all at once."""
    if not len(words):
        return np.empty(0, np.uint64)
    binary = words.cast(pa.large_binary())
    ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(words) + 1]
    begin, length = ends[:-1] - ends[0], np.diff(ends)
    data = np.zeros(ends[-1] - ends[0] + 16, np.uint8)
    data[:-16] = np.frombuffer(binary.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    # The eight bytes from each byte on.
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    head = eight[begin] & _BYTES[np.minimum(length, 8)]
    tail = eight[begin + 8] & _BYTES[np.clip(length - 8, 0, 8)]
    names = mix(mix(head + FACTOR * length.astype(np.uint64)) ^ tail * _SIDES[0])
    other = np.flatnonzero(length > 16)
    names[other] = hash_words(words.take(pa.array(other)))
    return names


def _least_runs(symbols: np.ndarray, low: np.ndarray, stop: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the run of symbols with the smallest hash begins between two places, and its hash; of equals the first."""
    width = stop - low - run + 1
    covered = np.bincount(low, minlength=len(symbols) + 1) - np.bincount(low + width, minlength=len(symbols) + 1)
    used = np.flatnonzero(np.cumsum(covered) > 0)
    hashes = symbols[used]
    for more in range(1, run):
        hashes = hashes * FACTOR + symbols[used + more]
    hashes = mix(hashes)
    # Upper half: the hash, lower half: the place, so that one minimum finds both.
    least = hashes & ~LOWER | np.arange(len(used), dtype=np.uint64)
    low = np.searchsorted(used, low) if len(used) < len(symbols) - run + 1 else low
    found, size = np.empty(len(low), np.uint64), 1
    while True:
        now = np.flatnonzero((width >= size) & (width < 2 * size))
        found[now] = np.minimum(least[low[now]], least[low[now] + width[now] - size])
        if 2 * size > width.max():
            break
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    at = (found & LOWER).astype(np.int64)
    return used[at], hashes[at]


def _owned(lists: pa.Array) -> np.ndarray:
    """Values of lists, each marked with its row."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type))
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    return (owner << OWNER_SHIFT) | np.asarray(lists.flatten()).astype(np.int64)


def _in(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _counted(found: DataFrame, *names: str) -> DataFrame:
    """For each name how often it occurs, and the row and place if it is once."""
    return found.groupBy(*names).agg(
        F.count(F.lit(1)).alias("k"), F.max("rid").alias("rid"), F.max("place").alias("place")
    )


def remove_repeats(
    docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every row with the text that is left, its number of words and of removed words.

    A word goes when a window of this many words that covers it starts anywhere
    else too.  What is left is joined by single spaces.
    """
    kept = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(*kept, F.xxhash64(key, text).alias("__rid"))
    source = text
    if text not in kept:
        source, rows = "__text", docs.select(*kept, F.xxhash64(key, text).alias("__rid"), F.col(text).alias("__text"))

    def symbols(batch):
        parse = Parse(batch.column(1), window)
        rid = np.asarray(batch.column(0))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((parse.names, parse.long_name)).view(np.int64)),
                pa.array(rid[np.concatenate((parse.places >> OWNER_SHIFT, parse.long_owner))]),
                pa.array(np.concatenate((parse.places & ((1 << OWNER_SHIFT) - 1), parse.long_code))),
            ],
            names=["name", "rid", "place"],
        )

    named = map_batches(rows.select("__rid", source), symbols, "name long, rid long, place long")
    # A repeated long symbol is sent to the one row that counts its windows for all.
    told = (
        _counted(named, "name").filter("k = 1 or place % 2 = 1").groupBy("rid")
        .agg(
            F.collect_list(F.when(F.col("k") == 1, F.col("place"))).alias("__lone"),
            F.collect_list(F.when(F.col("k") > 1, F.col("name"))).alias("__leads"),
        )
    )
    told = store(told.withColumnRenamed("rid", "__rid"), "recompression-symbols")
    joined = rows.join(told, "__rid", "left")

    def windows(batch):
        parse = Parse(batch.column(source), window)
        _, asked = parse.open(batch.column("__lone"))
        asked |= parse.leading(batch.column("__leads"))
        rid = np.asarray(batch.column("__rid"))
        one, two = parse.keys()
        begin = parse.start - parse.first[parse.whose]
        arrays = [one[asked], two[asked], rid[parse.whose[asked]], begin[asked]]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["one", "two", "rid", "place"])

    counted = map_batches(joined, windows, "one long, two long, rid long, place long")
    single = (
        _counted(counted, "one", "two").filter("k = 1").groupBy(F.col("rid").alias("__rid"))
        .agg(F.collect_list("place").alias("__single"))
    )
    columns = rows.select(*kept)

    def remove(batch):
        parse = Parse(batch.column(source), window)
        proven, asked = parse.open(batch.column("__lone"))
        single = np.sort(_owned(batch.column("__single")))
        begin = parse.start - parse.first[parse.whose]
        repeated = proven | (asked & ~_in(single, (parse.whose << OWNER_SHIFT) | begin))
        begins, size = parse.start[repeated], len(parse.hashes) + 1
        cover = np.bincount(begins, minlength=size) - np.bincount(begins + window, minlength=size)
        left = np.cumsum(cover)[:-1] == 0
        n_left = np.bincount(parse.owner[left], minlength=batch.num_rows)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n_left))), pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, parse.words.filter(pa.array(left))), " ")
        added = [texts, pa.array(parse.counts, pa.int64()), pa.array(parse.counts - n_left, pa.int64())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *added], names=[*kept, *RESULTS])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema)
    return map_batches(
        joined.join(single, "__rid", "left"), remove,
        f"{types}, kept_text string, n_words long, n_removed long",
    )
