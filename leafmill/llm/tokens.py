"""Token ids of whole texts with a public tokenizer, as tables of packed ids.

Byte-level pre-tokenisation always cuts a text before a blank that follows a
visible character, before a run of line feeds, and between a letter or digit and
ASCII punctuation.  So the ids of these cuts, one after the other, are the ids of
the text, and each distinct cut of a batch is looked up or encoded once.  Texts where
white space meets other white space, or with an added token, are encoded whole.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import kept

VOCABULARY = "byte_bpe_50k.json"
# White space of Unicode other than blank and line feed.
_OTHER_SPACE = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Texts that are encoded whole, whatever the tokenizer.
_WHOLE = f"{_OTHER_SPACE}|  |\n | \n"
# What a byte may be: ASCII punctuation, a letter or digit of one byte, first or second byte of a letter from U+00C0
# to U+017F (all are but those for times and divided by), blank, line feed.
_PUNCTUATION, _LETTER, _LEAD, _SECOND, _BLANK, _FEED = (1 << i for i in range(6))
_BYTES = bytes(
    _PUNCTUATION * (chr(b) in string.punctuation) + _LETTER * (chr(b) in string.ascii_letters + string.digits)
    + _LEAD * (0xC3 <= b <= 0xC5) + _SECOND * (0x80 <= b <= 0xBF and b not in (0x97, 0xB7))
    + _BLANK * (b == 0x20) + _FEED * (b == 0x0A)
    for b in range(256)
)
# Results that the tokenizer remembers for texts that are encoded whole.
CACHED = 10_000
# Cuts that a worker remembers.
REMEMBERED = 900_000
JOINED = 4096
# Bytes of text that are encoded together.
GATHERED = 8 << 20


def _cuts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The cuts of all texts in a row, and how many come before each text and after the last."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    held = np.frombuffer((data.to_pybytes() if data else b"").translate(_BYTES), np.uint8)[: bounds[-1]]
    opens = held == _BLANK
    feed = held == _FEED
    letter = held == _LETTER
    letter[1:] |= (held[:-1] == _LEAD) & (held[1:] == _SECOND)
    opens[1:] |= (feed[1:] & ~feed[:-1]) | (letter[:-1] & (held[1:] == _PUNCTUATION))
    opens[: bounds[0]] = False
    opens[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(opens)
    ends = pa.py_buffer(np.append(start, bounds[-1]).astype(np.int64))
    return pa.LargeStringArray.from_buffers(len(start), ends, data or pa.py_buffer(b"")), np.searchsorted(start, bounds)


class Encoder:
    """Encodes texts; ids come as bytes of little-endian 16- or 32-bit numbers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        #: ids that begin with a blank or a line feed
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] in ("\u0120", "\u010a")]] = True
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_WHOLE, *added])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, self.kind)
        self.start = np.zeros(1 << 14, np.int32)
        self.length = np.zeros(1 << 14, np.int32)
        self.filled = 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        return kept(("encoder", path), lambda: cls(path))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind) for e in done]

    def _remember(self, cuts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        begin, count = len(self.place), len(cuts)
        while begin + count > len(self.start):
            self.start, self.length = (np.concatenate((a, np.zeros_like(a))) for a in (self.start, self.length))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.length[begin : begin + count] = lengths
        self.start[begin : begin + count] = self.filled + np.cumsum(lengths) - lengths
        self.filled += len(ids)
        self.place.update(zip(cuts, range(begin, begin + count)))

    def _ids(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of these cuts, one after the other."""
        ends = np.cumsum(lengths)
        kind = np.int32 if ends[-1:].sum() < 1 << 31 and self.filled < 1 << 31 else np.int64
        from_here = (self.start[at] - (ends - lengths)).astype(kind)
        return self.ids[np.repeat(from_here, lengths) + np.arange(lengths.sum(), dtype=kind)]

    def _learn(self, cuts: list[str]) -> None:
        """Encode new cuts; those that begin with one blank or line feed as one text of many."""
        self.tokenizer.model._resize_cache(0)  # no cut comes twice
        single = []
        many = [c for c in cuts if c[:1] in (" ", "\n") and c[1:2] not in ("", "\n") or single.append(c)]
        for at in range(0, len(many), JOINED):
            some = many[at : at + JOINED]
            (ids,) = self._encode(["".join(some)])
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) == len(some) and begin[0] == 0:
                self._remember(some, ids, np.diff(np.append(begin, len(ids))))
            else:
                single += some
        for at in range(0, len(single), JOINED):
            some = single[at : at + JOINED]
            ids = self._encode(some)
            self._remember(some, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))
        self.tokenizer.model._resize_cache(CACHED)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        whole = np.asarray(pc.match_substring_regex(texts, self.whole))
        pieces, first = _cuts(pc.if_else(pa.array(whole), "", texts))
        coded = pieces.dictionary_encode()
        # No cut holds a carriage return, so one long text carries them all.
        one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        cuts = pc.binary_join(one, pa.scalar("\r", pa.large_string()))[0].as_py().split("\r") if len(pieces) else []
        if len(self.place) > REMEMBERED or self.filled > 8 * REMEMBERED:
            self.forget()
        if new := [c for c in cuts if c not in self.place]:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, cuts), np.int64, len(cuts))[np.asarray(coded.indices)]
        lengths = self.length[at]
        ids = self._ids(at, lengths)
        bounds = np.append(0, np.cumsum(lengths))[first]
        out = [ids[b:e].tobytes() for b, e in zip(bounds[:-1], bounds[1:])]
        odd = np.flatnonzero(whole)
        for row, found in zip(odd, self._encode([texts[int(i)].as_py() for i in odd])):
            out[row] = found.tobytes()
        return out


def encode(docs: DataFrame, path: str, key: str, text: str, end_id: int) -> DataFrame:
    """Per row: key, n (ids with the end id), ids (packed 16- or 32-bit numbers)."""

    def run(batches):
        encoder, held, size = Encoder.of(path), [], 0
        end = np.array([end_id], dtype=encoder.kind).tobytes()

        def ready():
            table = pa.Table.from_batches(held).combine_chunks()
            ids = [i + end for i in encoder(table.column(1).combine_chunks())]
            n = [len(i) // encoder.kind.itemsize for i in ids]
            made = pa.table({"key": table.column(0), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})
            return made.to_batches(max_chunksize=1024)

        for batch in batches:  # the more texts at a time, the more words they share
            held.append(batch)
            size += batch.nbytes
            if size >= GATHERED:
                yield from ready()
                held, size = [], 0
        if held:
            yield from ready()

    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return columns.mapInArrow(run, f"key {kind}, n long, ids binary")


def id_kind(path: str) -> np.dtype:
    return Encoder.of(path).kind


def wide(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return ids.astype("<u4").tobytes()
