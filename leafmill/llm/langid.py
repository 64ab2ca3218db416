"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over *all* ways to cut it into pieces,
computed with a forward pass that is rescaled as it goes along, so that no
probability becomes 0; a text's is the product over its words.  Piece
probabilities are learned by expectation maximisation: a forward-backward pass
gives the expected use of each piece.

Words are lower-cased and marked at their start as the vocabulary does; words
over ``LONGEST_WORD`` code points are read in slices of that length.  A
character outside the vocabulary is one unknown piece.

Cases: null text, empty text or text without a letter gives ``und`` with score
0; without any labelled text every row is ``und``; repeated rows get the same
answer; further columns of the input are kept out of the way and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import WORD, kept, sampled, split_words
from leafmill.session import store

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_LANGUAGE = "und"
LONGEST_WORD = 48
# Longer pieces of the vocabulary are left out, so that a lattice stays narrow.
LONGEST_PIECE = 8
# Places of a lattice after which probabilities are brought back to about 1.
RESCALED = 8
MARK = "▁"
# Strength of the pull towards the probabilities of all languages together.
SMOOTHING = 500.0
# Tasks for a pass over the (bounded) sample; its rows are few but dear.
FIT_TASKS = 24
# Words whose probabilities one worker remembers.
REMEMBERED = 300_000


class Pieces:
    """The vocabulary's pieces that stand for text, numbered from 0, in a hash table.

    A piece is found by a hash of its code points, so that all substrings of
    one length of many words are looked up in one step.
    """

    BITS = 19
    STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [
            model.id_to_piece(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        usable = [p for p in usable if len(p) <= LONGEST_PIECE]
        self.size, self.unknown = len(usable) + 1, len(usable)
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.values = np.full(1 << self.BITS, -1, np.int32)
        self.probes = 1
        for group in by_length(usable):
            codes = code_points([usable[i] for i in group])
            key = np.zeros(len(group), np.uint64)
            for at in range(codes.shape[1]):
                key = self.grow(key, codes[:, at])
            for number, key, at in zip(group.tolist(), key.tolist(), self.slot(key).tolist()):
                probe = 1
                while self.values[at] >= 0:
                    at, probe = (at + 1) % len(self.keys), probe + 1
                self.keys[at], self.values[at] = key, number
                self.probes = max(self.probes, probe)

    @classmethod
    def of(cls, path: str) -> Pieces:
        """The table of this worker."""
        return kept(("pieces", path), lambda: cls(path))

    def grow(self, key: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (key + codes.astype(np.uint64) + np.uint64(1)) * self.STEP

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key ^ (key >> np.uint64(29))) * self.SPREAD >> np.uint64(64 - self.BITS)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        slot = self.slot(key).astype(np.int64)
        out = np.where(self.keys[slot] == key, self.values[slot], -1)
        for probe in range(1, self.probes):
            at = (slot + probe) & (len(self.keys) - 1)
            out = np.where((self.keys[at] == key) & (out < 0), self.values[at], out)
        return out


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


class Lattice:
    """All places where pieces fit into words of one length.

    ``found[l - 1][:, i]`` is the piece of length l at place i, or -1.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        codes = code_points(words)
        self.length = codes.shape[1]
        self.found: list[np.ndarray] = []
        key = np.zeros(codes.shape, np.uint64)
        for size in range(1, min(self.length, LONGEST_PIECE) + 1):
            key = pieces.grow(key[:, : self.length - size + 1], codes[:, size - 1 :])
            piece = pieces.find(key)
            self.found.append(np.where(piece < 0, pieces.unknown, piece) if size == 1 else piece)

    def forward(self, table: np.ndarray) -> np.ndarray:
        """Probability of each beginning of each word; ``table``: piece x column, last row 0."""
        out, logs = self.scaled_forward(table)
        return out * np.exp(logs)

    def backward(self, table: np.ndarray) -> np.ndarray:
        out, logs = self.scaled_backward(table)
        return out * np.exp(logs)

    def scaled_forward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings as numbers that a double holds, and the logarithms of their factors.

        The places that pieces still reach have one factor, which makes the last
        of them 1.  As every character alone is a piece, the place before is at
        most one over the smallest probability of a piece, and so on.
        """
        out = np.zeros((self.length + 1, len(self.found[0]), table.shape[1]))
        logs = np.zeros_like(out)
        out[0] = 1.0
        for end in range(1, self.length + 1):
            for size, found in enumerate(self.found[:end], 1):
                out[end] += out[end - size] * table[found[:, end - size]]
            logs[end] = logs[end - 1]
            if end % RESCALED == 0:
                _rescale(out, logs, slice(max(end + 1 - LONGEST_PIECE, 0), end + 1), end)
        return out, logs

    def scaled_backward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((self.length + 1, len(self.found[0]), table.shape[1]))
        logs = np.zeros_like(out)
        out[self.length] = 1.0
        for start in range(self.length - 1, -1, -1):
            for size, found in enumerate(self.found[: self.length - start], 1):
                out[start] += out[start + size] * table[found[:, start]]
            logs[start] = logs[start + 1]
            if (self.length - start) % RESCALED == 0:
                _rescale(out, logs, slice(start, start + LONGEST_PIECE), start)
        return out, logs


def _rescale(out: np.ndarray, logs: np.ndarray, places: slice, last: int) -> None:
    """Divide these places, which have one factor, by the last of them."""
    by = out[last].copy()
    out[places] /= by
    logs[places] = logs[last] + np.log(by)


def by_length(words: list[str]) -> list[np.ndarray]:
    """Which words have the same length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []


def closed(table: np.ndarray) -> np.ndarray:
    """The table with a last row of zeros, for -1."""
    return np.vstack((table, np.zeros((1, table.shape[1]))))


def slices_of(word: str) -> list[str]:
    word = MARK + word.lower()
    return [word[i : i + LONGEST_WORD] for i in range(0, len(word), LONGEST_WORD)]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # piece x language
    path: str


def _expected(pieces: Pieces, words: pd.DataFrame, table: np.ndarray) -> pd.DataFrame:
    """Expected uses of each piece by language, for rows (language, word, n)."""
    cut = [(s, l, n) for w, l, n in zip(words.word, words.language, words.n) for s in slices_of(w)]
    texts = [s for s, _, _ in cut]
    language = np.array([l for _, l, _ in cut], dtype=np.int64)
    n = np.array([n for _, _, n in cut], dtype=np.float64)
    uses = np.zeros((table.shape[1], pieces.size))
    for spoken in np.unique(language):
        mine, part = np.flatnonzero(language == spoken), closed(table[:, [spoken]])
        for rows in by_length([texts[i] for i in mine]):
            rows = mine[rows]
            lattice = Lattice([texts[i] for i in rows], pieces)
            ahead, behind = (
                (np.log(out) + logs)[:, :, 0]
                for out, logs in (lattice.scaled_forward(part), lattice.scaled_backward(part))
            )
            for size, found in enumerate(lattice.found, 1):
                for start in range(lattice.length - size + 1):
                    fits = np.flatnonzero(found[:, start] >= 0)
                    piece = found[fits, start]
                    share = np.exp(ahead[start, fits] + behind[start + size, fits] - ahead[lattice.length, fits])
                    uses[spoken] += np.bincount(piece, n[rows[fits]] * part[piece, 0] * share, pieces.size)
    key = np.flatnonzero(uses)
    return pd.DataFrame({"key": key, "weight": uses.reshape(-1)[key]})


def fit(
    docs: DataFrame, path: str, text: str = "text", lang: str = "lang",
    key: str = "doc_id", max_docs: int = 2000, rounds: int = 2,
) -> LanguageModel:
    """Learn from the rows that have a text and a language.

    ``max_docs`` bounds the sample the model is fitted on: about so many rows,
    chosen by a hash of the key.  What reaches the driver is one number for
    each piece and language.
    """
    labelled = docs.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")
    ).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    size = Pieces.of(path).size
    if not languages:
        return LanguageModel([], np.zeros((size, 0)), path)
    rate = min(1.0, max_docs / sum(counts.values()))
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    words = (
        labelled.filter(sampled(F.col("key"), rate))
        .select(number[F.col("lang")].alias("language"), F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("word"))
        .groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    )
    words = store(words.repartition(FIT_TASKS, "word"), "langid-words")
    table = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        now = table

        def expect(frames, now=now):
            known = Pieces.of(path)
            for frame in frames:
                for at in range(0, len(frame), 50_000):
                    yield _expected(known, frame.iloc[at : at + 50_000], now)

        use = words.mapInPandas(expect, "key long, weight double").groupBy("key").agg(F.sum("weight").alias("weight"))
        counts_of = np.zeros(len(languages) * size)
        for row in use.collect():
            counts_of[row["key"]] = row["weight"]
        by_piece = counts_of.reshape(len(languages), size).T
        shared = (by_piece.sum(1) + 1.0) / (by_piece.sum() + size)
        table = (by_piece + SMOOTHING * shared[:, None]) / (by_piece.sum(0) + SMOOTHING)
    return LanguageModel(languages, table, path)


class _Scorer:
    """Log probabilities of words by language; remembers a bounded number of words."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, Pieces.of(model.path)
        self.table = closed(model.table)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((REMEMBERED, len(self.model.languages)), dtype=np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.model.languages)))
        place = np.fromiter((self.at.get(w, -1) for w in words), np.int64, len(words))
        out[place >= 0] = self.rows[place[place >= 0]]
        new = np.flatnonzero(place < 0)
        for begin in range(0, len(new), 50_000):
            some = new[begin : begin + 50_000]
            out[some] = self.score([words[i] for i in some])
        if len(self.at) + len(new) > REMEMBERED:
            self.at.clear()
        for i in new[:REMEMBERED]:
            self.rows[len(self.at)] = out[i]
            self.at[words[i]] = len(self.at)
        return out

    def score(self, words: list[str]) -> np.ndarray:
        cut = [slices_of(w) for w in words]
        texts = [s for c in cut for s in c]
        whole = np.empty((len(texts), self.table.shape[1]))
        for rows in by_length(texts):
            lattice = Lattice([texts[i] for i in rows], self.pieces)
            out, logs = lattice.scaled_forward(self.table)
            whole[rows] = np.log(out[lattice.length]) + logs[lattice.length]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.add.reduceat(whole, np.concatenate(([0], np.cumsum(sizes)[:-1])))


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text",
    out: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """Every row with its most probable language and that language's share.

    The share is the posterior under equal priors.  Columns of the input are
    kept; those named like the new ones are replaced.
    """
    others = [c for c in docs.columns if c not in out]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)

    def run(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or _Scorer(model)
            texts = batch.column(batch.schema.get_field_index(text))
            named = _identify_texts(texts, scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + named, names=[*others, *out]
            )

    return docs.mapInArrow(run, f"{types}, {out[0]} string, {out[1]} double")


def _identify_texts(texts: pa.Array, scorer: _Scorer) -> list[pa.Array]:
    languages = scorer.model.languages
    words, counts = split_words(texts)
    readable = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    if not languages:
        readable[:] = False
        languages = [UNKNOWN_LANGUAGE]
        total = np.zeros((len(texts), 1))
    else:
        coded = words.dictionary_encode()
        by_word = scorer.words(coded.dictionary.to_pylist()) if len(words) else np.zeros((1, len(languages)))
        owner, index = np.repeat(np.arange(len(texts)), counts), np.asarray(coded.indices)
        total = np.stack(
            [np.bincount(owner, by_word[index, l], len(texts)) for l in range(len(languages))], axis=1
        )
    best = total.argmax(1)
    share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    names = [languages[b] if ok else UNKNOWN_LANGUAGE for b, ok in zip(best, readable)]
    return [pa.array(names, pa.string()), pa.array(np.where(readable, share, 0.0))]


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_ids(docs: DataFrame, path: str) -> DataFrame:
    """Fit on the rows that are not held out, then identify every row."""
    marked = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(marked.filter("not held_out"), path)
    return identify(marked.select("doc_id", "held_out", "text"), model)
