"""Substring removal, n-gram join, fingerprints and language identification."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.llm import common, langid, ngram_join, recompression, spotsigs
from leafmill.llm.components import connected_components
from leafmill.llm.queries import vocabulary
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def result(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, FOLDER).collect()]


def test_repeats_of_given_documents(spark, given):
    found = {r["doc_id"]: r for r in result(spark, "op4_substring_dedup")}
    expected = brute.kept_after_repeats(given.values(), 35)
    assert len(found) == len(given)
    for key, (all_words, left) in zip(given, expected):
        digest = hashlib.sha256(" ".join(left).encode()).hexdigest()
        assert found[key] == {
            "doc_id": key, "n_words": len(all_words), "n_removed": len(all_words) - len(left), "kept_sha256": digest,
        }


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_few_words_and_runs(spark, seed):
    """Random copies, periods and runs over a small vocabulary."""
    rng, texts = random.Random(seed), []
    for _ in range(60):
        kind = rng.randrange(4)
        text = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90))]
        if kind == 1 and texts:
            other = rng.choice(texts).split()
            at = rng.randrange(len(other) + 1)
            text[10:10] = other[at : at + rng.randrange(40)]
        if kind == 2:
            text = [rng.choice("ab")] * rng.randrange(1, 40) + text
        if kind == 3:
            text = (text[:3] or ["a"]) * rng.randrange(1, 30)
        texts.append(" ".join(text))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in recompression.remove_repeats(frame, window=8).collect()}
    for key, (all_words, left) in enumerate(brute.kept_after_repeats(texts, 8)):
        assert (found[key]["kept_text"], found[key]["n_words"]) == (" ".join(left), len(all_words)), texts[key]


def test_windows_beside_each_other_take_the_same():
    """What a window takes is counted in a shuffle; a window per third or fourth of them is too many."""
    rng = random.Random(5)
    texts = pa.array([" ".join(f"w{rng.randrange(50_000)}" for _ in range(500)) for _ in range(40)])
    parse = recompression.Parse(texts, 35)
    assert len(parse.code) == 40 * 466
    taken = np.unique((parse.whose << recompression.OWNER_SHIFT) | parse.code)
    assert len(taken) < 0.16 * len(parse.code)


def test_equal_windows_take_equal_symbols():
    """Wherever they stand: first or last in a text or a batch, in runs, among few symbols."""
    rng = random.Random(6)
    for size, window in ((3, 1), (4, 5), (12, 9), (60, 35)):
        passage = [rng.choice("abc") for _ in range(size)] + ["a"] * (size // 3) + [rng.choice("ab") for _ in range(window)]
        around = [[], ["a"] * 40, [rng.choice("abcdef") for _ in range(30)], passage]
        texts = [" ".join(x + passage + y) for x in around for y in around]
        found = {}
        for batch in (texts, *([t] for t in texts)):
            parse = recompression.Parse(pa.array(batch), window)
            for key, name in zip(parse.keys()[0], parse.names[parse.which]):
                assert found.setdefault(key, name) == name


def test_short_words_are_hashed_all_at_once(monkeypatch):
    """Only words of more than 16 bytes are hashed one by one."""
    words = [chr(97 + n % 26) * (n % 23 + 1) + str(n) for n in range(4000)] + ["a", "a\x00", "\x00", "\x00a", "é" * 8, "é" * 9]
    digest, long = common.xxhash.xxh3_64_intdigest, []
    monkeypatch.setattr(common.xxhash, "xxh3_64_intdigest", lambda w, seed=0: long.append(w) or digest(w, seed))
    parse = recompression.Parse(pa.array([" ".join(words), " ".join(reversed(words))]), 35)
    assert sorted(long) == sorted(w.encode() for w in words if len(w.encode()) > 16)
    assert len(np.unique(parse.hashes)) == len(words)
    assert (parse.hashes[: len(words)] == parse.hashes[len(words) :][::-1]).all()


def test_repeats_of_odd_documents(odd, rows, empty):
    found = recompression.remove_repeats(odd)
    assert found.columns == [*odd.columns, *recompression.RESULTS]
    got = sorted(map(str, ((r["doc_id"], r["text"], r["kept_text"], r["n_words"]) for r in found.collect())))
    expected = brute.kept_after_repeats([t for _, t, _ in rows], 35)
    assert got == sorted(
        str((k, t, " ".join(left), len(w))) for (k, t, _), (w, left) in zip(rows, expected)
    )
    assert recompression.remove_repeats(empty).count() == 0


def test_ngram_join_of_given_documents(spark, given):
    found = {r["doc_id"]: r for r in result(spark, "op7_ngram_jaccard")}
    keys, sets = list(given), [brute.shingles(t, 4) for t in given.values()]
    for at, label in enumerate(brute.components(sets, 85)):
        assert found[keys[at]]["component_id"] == keys[label]
        assert found[keys[at]]["n_shingles"] == len(sets[at])


@pytest.mark.parametrize(("seed", "percent"), [(0, 80), (1, 85), (2, 60)])
def test_ngram_join_of_near_copies(spark, seed, percent):
    """Chains of edited copies of few originals, short and long, in one large group each."""
    rng, texts = random.Random(seed), []
    for size in (6, 15, 40, 120):
        original = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(25):
            text = list(rng.choice([original, texts[-1].split() if texts else original]))
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(text))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(frame, 3, percent).collect()}
    expected = brute.components([brute.shingles(t, 3) for t in texts], percent)
    assert [found[i] for i in range(len(texts))] == expected


def test_ngram_join_of_odd_documents(odd, rows, empty):
    found = sorted(str(tuple(r)) for r in ngram_join.ngram_components(odd).collect())
    sets = [brute.shingles(t, 5) for _, t, _ in rows]
    labels = brute.components(sets, 80)
    smallest = [min((k for (k, *_), m in zip(rows, labels) if m == l and k is not None), default=None) for l in labels]
    assert found == sorted(str((k, len(s), c)) for (k, *_), s, c in zip(rows, sets, smallest))
    assert ngram_join.ngram_components(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r["id"]: r["label"] for r in connected_components(frame).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_fingerprints_of_given_documents(spark, given):
    found = {r["doc_id"]: r for r in result(spark, "op9_spotsigs")}
    keys = sorted(given, reverse=True)
    for at, key in enumerate(keys):
        text, following = given[key], given[keys[(at + 1) % len(keys)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert found[key]["n_chars"] == len(text)
        assert found[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[key]["near_next"] <= 1 and 0 <= found[key]["near_edited"] <= 1
    near = [r["near_edited"] for r in found.values()]
    assert sum(near) / len(near) > 0.4 > 0.1 > sum(r["near_next"] for r in found.values()) / len(near)


def test_signatures_are_chains_after_common_words(spark):
    text = "The quick, brown fox of the LAZY dog."
    frame = spark.createDataFrame([(text,), ("brown fox",), ("",), ("!!",)], "text string")
    found = spotsigs.with_signatures(frame, "text", "sigs").collect()
    spots = ["\u0001the quick brown", "\u0001of lazy dog", "\u0001the lazy dog"]
    wanted = spark.createDataFrame([(s,) for s in spots], "s string").select(
        F.hash("s").alias("h")
    )
    assert found[0]["sigs"] == sorted(r["h"] for r in wanted.collect())
    assert [len(r["sigs"]) for r in found] == [3, 1, 0, 1]


def test_fingerprints_of_odd_documents(odd, rows, empty):
    found = spotsigs.with_next(odd).collect()
    assert len(found) == len(rows)
    by_text = {}
    for r in found:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert spotsigs.with_next(empty).count() == 0


def test_similar_fingerprints(spark, given):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sets = {r["doc_id"]: set(r["sigs"]) for r in spotsigs.with_signatures(frame, "text", "sigs").collect()}
    keys = sorted(sets)
    expected = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        for i, a in enumerate(keys) for b in keys[i + 1 :]
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    }
    classes = {r["doc_id"]: r["class_id"] for r in spotsigs.similar(frame, 0.8).collect()}
    parent = {k: k for k in keys}
    for _ in keys:
        for a, b in expected:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert classes == parent


def test_languages_of_held_out_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.language_ids(frame, vocabulary(langid.VOCABULARY)).join(frame.select("doc_id", "lang"), "doc_id")
    held = [r for r in found.collect() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_forward_pass_sums_all_segmentations():
    import numpy as np

    pieces = langid.Pieces.of(vocabulary(langid.VOCABULARY))
    table = np.random.default_rng(1).random((pieces.size, 2))
    word = "▁there"
    lattice = langid.Lattice([word], pieces)

    def total(at):
        if at == len(word):
            return np.ones(2)
        out = np.zeros(2)
        for size, found in enumerate(lattice.found[: len(word) - at], 1):
            if found[0, at] >= 0:
                out += table[found[0, at]] * total(at + size)
        return out

    ahead = lattice.forward(langid.closed(table))
    assert np.allclose(ahead[len(word), 0], total(0))
    assert np.allclose(lattice.backward(langid.closed(table))[0, 0], total(0))


def test_languages_of_odd_documents(odd, rows, empty):
    path = vocabulary(langid.VOCABULARY)
    found = langid.language_ids(odd, path).collect()
    assert len(found) == len(rows)
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert langid.language_ids(empty, path).count() == 0
    unlabelled = langid.language_ids(odd.withColumn("lang", F.lit(None).cast("string")), path)
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_long_words_of_unseen_characters(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang is not null")
    model = langid.fit(frame, vocabulary(langid.VOCABULARY))
    english = frame.filter("lang = 'en' and n_chars > 500").orderBy("doc_id").first()["text"]
    unseen = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 200))
    texts = [unseen, f"{english} {unseen}", f"{unseen} {english}", english]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["en"] * 3


def test_expected_pieces_of_words_with_tiny_probability():
    import numpy as np
    import pandas as pd

    pieces = langid.Pieces.of(vocabulary(langid.VOCABULARY))
    words = pd.DataFrame({"language": [0], "word": ["".join(chr(c) for c in range(0x4E00, 0x4E00 + 47))], "n": [3]})
    uses = langid._expected(pieces, words, np.full((pieces.size, 1), 1e-9))
    assert np.isfinite(uses["weight"]).all() and 0 < uses["weight"].sum() <= 3 * 48 + 1e-6
