"""Near copies by MinHash against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.llm import minhash, ngram_join
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def same_classes(found, texts, n, percent):
    sets = [brute.shingles(t, n) for t in texts]
    for at, label in enumerate(brute.components(sets, percent)):
        assert found[at] == {"doc_id": at, "n_shingles": len(sets[at]), "component_id": label, "kept": at == label}


def result(frame):
    return {r["doc_id"]: r.asDict() for r in frame.collect()}


def near_copies(seed, groups=(6, 15, 40, 120), copies=25):
    """Chains of edited copies of few originals, short and long, in one large group each."""
    rng, texts = random.Random(seed), []
    for size in groups:
        original = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(copies):
            copy = list(original)
            for _ in range(rng.randrange(1 + size // 12)):
                copy[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                original = copy
    rng.shuffle(texts)
    return texts


def test_given_documents(spark, given):
    found = result(entry.queries()["op11_minhash"](spark, FOLDER))
    keys, sets = list(given), [brute.shingles(t, 4) for t in given.values()]
    for at, label in enumerate(brute.components(sets, 80)):
        assert found[keys[at]] == {
            "doc_id": keys[at], "n_shingles": len(sets[at]), "component_id": keys[label], "kept": at == label,
        }


@pytest.mark.parametrize(("seed", "n", "percent"), [(0, 4, 80), (1, 5, 85)])
def test_near_copies(spark, seed, n, percent):
    texts = near_copies(seed)
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    same_classes(result(minhash.minhash_components(frame, n=n, percent=percent)), texts, n, percent)


def test_crowded_buckets(spark, monkeypatch):
    """With nearly every bucket crowded, the longer bands of the next levels find the same classes."""
    texts = near_copies(7)
    monkeypatch.setattr(minhash, "FEW", 0)
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(4)
    same_classes(result(minhash.minhash_components(frame, n=4, percent=80)), texts, 4, 80)


def test_links_that_no_centre_sees(spark):
    """Copies of copies: both ends of a link may be too far from their centre."""
    rng = random.Random(2)
    centre = [f"c{i}" for i in range(200)]
    texts = [" ".join(centre)]
    for arm in range(8):
        text = list(centre)
        for step in range(6):
            for _ in range(3):
                text[rng.randrange(200)] = f"x{arm}.{step}.{rng.random()}"
            texts.append(" ".join(text))
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    same_classes(result(minhash.minhash_components(frame, n=4, percent=80)), texts, 4, 80)


def test_odd_documents(odd, rows, empty):
    found = minhash.minhash_components(odd, n=5, percent=80).collect()
    sets = [brute.shingles(t, 5) for _, t, _ in rows]
    labels, expected = brute.components(sets, 80), []
    for at, (key, _, _) in enumerate(rows):
        inside = [rows[i][0] for i in range(len(rows)) if labels[i] == labels[at] and rows[i][0] is not None]
        smallest = min(inside, default=None) if sets[at] else key
        expected.append((key, len(sets[at]), smallest, key == smallest))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert minhash.minhash_components(empty).count() == 0


def test_rows_of_one_key_stay_linear(spark):
    """Texts are fetched by key and text, not by key alone."""
    rows = [(5, f"{i} " + "some words of one and the same text " * 3) for i in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    marked = minhash._marked(frame, "doc_id", "text", 4)
    assert minhash._texts(marked.select("entity").distinct(), marked, frame, "doc_id", "text").count() == 200
    found = minhash.minhash_components(frame, n=4, percent=80).collect()
    assert len(found) == 200 and {r["component_id"] for r in found} == {5}


@pytest.mark.parametrize("size", [1, 2, 5, 40, 400])
def test_agreement_of_signatures_is_the_similarity(size):
    """Bins agree as often as the sets' share in common, densified bins too."""
    rng, shares, agreed = np.random.default_rng(size), [], []
    for _ in range(60):
        grams = rng.integers(-(1 << 63), (1 << 63) - 1, size=size + max(1, size // 4))
        a, b = np.sort(grams[:size]), np.sort(grams[len(grams) - size :])
        both = minhash.signature(np.concatenate([a, b]), np.array([size, size]), 160)
        assert (both != 0).all() and set(both[0]) <= set(minhash.signature(a, np.array([size]), 160)[0])
        shares.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        agreed.append((both[0] == both[1]).mean())
    assert abs(np.mean(agreed) - np.mean(shares)) < 0.05


def test_stars_bound_the_pairs(spark):
    """A group of near copies proposes at most one pair for each row of a bucket."""
    texts = near_copies(3, groups=(120,), copies=120)
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    grams, counts = ngram_join.shingle_sets(pa.array(texts), 4)
    marked = minhash._marked(frame, "doc_id", "text", 4)
    entities = marked.groupBy("entity").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    starred = minhash._starred(entities)
    assert minhash._likeliest(starred, 80).count() < len(counts)
    alone = starred.withColumn("own", F.col("entity")).withColumn("main", F.col("centre"))
    assert minhash._outside(alone, 80).count() <= starred.count() <= len(counts) * minhash.LEVELS[0][1]
