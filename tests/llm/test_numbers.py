"""Sharding, mixing, token files, packing, quality scores and vector search."""

import gc
import random
import struct
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leafmill.llm import ans, fm, langid, mixing, packing, rabitq, shards, tokens
from leafmill.llm.queries import vocabulary
from leafmill.session import new_folder
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def result(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, FOLDER).collect()]


def encoded(texts, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(tokens.VOCABULARY))
    done = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, end], dtype="<u4") for e in done]


# Sharding


def check_shards(rows, size_of):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    return {s: sum(size_of(r) for r in m) for s, m in by_shard.items()}


def test_shards_of_given_documents(spark, given):
    found = result(spark, "op1_kd_shards")
    assert len(found) == len(given)
    for r in found:
        data = given[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
    sizes = check_shards(found, lambda r: r["size"])
    mean, largest = sum(sizes.values()) / 16, max(r["size"] for r in found)
    assert set(sizes) == set(range(16)) and all(abs(s - mean) <= 2 * largest for s in sizes.values())


def test_shards_are_balanced_with_one_hot_source(spark):
    rows = [(i, "x" * (50 + i % 7), "hot" if i % 3 else f"s{i % 40}", "en") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for wanted in (16, 7):
        sizes = check_shards([r.asDict() for r in shards.kd_shards(frame, shards=wanted).collect()], lambda r: r["size"])
        mean = sum(sizes.values()) / wanted
        assert len(sizes) == wanted and all(abs(s - mean) < 0.02 * mean for s in sizes.values())
    target = sum(len(t) + 1 for _, t, _, _ in rows) // 5
    assert len({r["shard"] for r in shards.kd_shards(frame, target_bytes=target).collect()}) in (5, 6)


def test_shards_of_odd_documents(odd, rows, empty):
    found = [r.asDict() for r in shards.kd_shards(odd, shards=4).collect()]
    check_shards(found, lambda r: r["size"])
    assert sorted(str((r["doc_id"], r["size"])) for r in found) == sorted(
        str((k, len((t or "").encode()) + 1)) for k, t, _ in rows
    )
    assert shards.kd_shards(empty, shards=4).count() == 0


# Mixing


def level(sizes, weights, share, most):
    """Targets by giving and giving again."""
    targets, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        per = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if targets[s] + per * weights[s] >= most * sizes[s]}
        for s in full or open_:
            given = most * sizes[s] - targets[s] if full else per * weights[s]
            targets[s] += given
            left -= given
        open_ -= full
        if not full:
            break
    return targets


def check_mix(found, rows, slack):
    size = lambda t: len(brute.words(t))
    by_source = {}
    for _, t, s in rows:
        by_source[s] = by_source.get(s, 0) + size(t)
    order = sorted(by_source, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets = level(by_source, weights, 1.5, 2.0)
    assert sorted(str((r["doc_id"], r["size"])) for r in found) == sorted(str((k, size(t))) for k, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = {}
    source = {(k, size(t)): s for k, t, s in rows}
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == by_source[s] and abs(r["target"] - targets[s]) < 1e-6
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= slack(by_source[s]), (s, taken[s], t)


def test_mix_of_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").collect()]
    found = result(spark, "op2_mix_sources")
    check_mix(found, rows, lambda size: 0.05 * size + 20)
    assert sorted(map(str, found)) == sorted(map(str, result(spark, "op2_mix_sources")))


def test_mix_of_odd_documents(odd, rows, empty):
    check_mix([r.asDict() for r in mixing.mix(odd).collect()], rows, lambda size: size)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert {(r["doc_id"], r["text"]) for r in mixed.collect()} <= {(k, t) for k, t, _ in rows}


def test_flight_keeps_sums_and_chances():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 900, 300).astype(float)
    seen = np.zeros(300)
    for seed in range(200):
        flown = mixing.fly(size, np.full(300, 0.3), np.random.default_rng(seed))
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        assert abs(flown.sum() - 90) < 1e-6 and abs(flown @ size - 0.3 * size.sum()) < 1e-3
        seen += flown
    assert abs(seen.mean() / 200 - 0.3) < 1e-6 and np.abs(seen / 200 - 0.3).max() < 0.2


def test_mix_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 5 > 0]) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix([r.asDict() for r in mixing.mix(frame).collect()], rows, lambda size: 9)


# Token files and packing


def test_token_files_of_given_documents(spark, given):
    found = {r["doc_id"]: r for r in result(spark, "op3_token_files")}
    keys, start = sorted(given), 0
    for key, ids in zip(keys, encoded([given[k] for k in keys], 0)):
        assert found[key] == {
            "doc_id": key, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()),
        }
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 256 * 512, 256 * 512 + 1, 300_001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.002, n), 40_000)
    coder = ans.Coder(ans.scaled(np.bincount(ids, minlength=65_536) if n else np.ones(10)))
    payload = coder.encode(ids)
    assert (coder.decode(payload) == ids).all()
    if n > 100_000:
        p = np.bincount(ids) / n
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
        assert len(payload) < 1.03 * entropy


def test_one_symbol_and_damage():
    coder = ans.Coder(ans.scaled(np.bincount([7] * 5)))
    payload = coder.encode(np.full(1000, 7))
    assert (coder.decode(payload) == 7).all()
    with pytest.raises(ValueError):
        coder.decode(b"XXXX" + payload[4:])


def test_damaged_file_is_noticed(spark, odd):
    folder = new_folder(spark, "damage")
    ans.write_token_files(odd, vocabulary(tokens.VOCABULARY), folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    spark.read.parquet(f"{folder}/frequencies").write.parquet(f"{folder}-bad/frequencies")
    blocks.withColumn("crc32", F.col("crc32") + 1).write.parquet(f"{folder}-bad/blocks")
    with pytest.raises(Exception, match="checksum"):
        ans.read_token_files(spark, f"{folder}-bad").collect()


def test_token_files_of_odd_documents(odd, rows, empty):
    found = ans.round_trip(odd, vocabulary(tokens.VOCABULARY)).collect()
    expected = sorted(str((k, len(i), zlib.crc32(i.tobytes()))) for (k, *_), i in zip(rows, encoded([t for _, t, _ in rows], 0)))
    assert sorted(str((r["key"], r["n_tokens"], zlib.crc32(r["ids"]))) for r in found) == expected
    starts = sorted((r["start"], r["n_tokens"]) for r in found)
    assert [s for s, _ in starts] == list(np.concatenate(([0], np.cumsum([n for _, n in starts])[:-1])))
    keys = [r["key"] for r in sorted(found, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert ans.round_trip(empty, vocabulary(tokens.VOCABULARY)).count() == 0


def test_cut_texts_have_the_ids_of_whole_texts():
    rng = random.Random(2)
    parts = ["word", " ", "\n", "  ", "\t", "’s", "'s", "né", "日本", "12", "!?", " ", "\x1c", "<|endoftext|>", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(800)]
    ids = tokens.Encoder.of(vocabulary(tokens.VOCABULARY))(pa.array(texts))
    assert ids == [e[:-1].astype("<u2").tobytes() for e in encoded(texts, 0)]


def test_cuts_at_punctuation_have_the_ids_of_whole_texts():
    rng = random.Random(3)
    parts = [
        "word", " ", " ", "\n", "\n\n", "é", "Ç", "ſ", "×", "÷", "Ω", "ж", "日", "e\u0301", "ß", "\u01c5", "½", "7", ",", ".", "_",
        "'s", "'", "'ll", "$$$", "-", "<", "|", ">", "<|endoftext|>", "\0", "\U0001f600",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["", None, "é,é×.ÿ÷!"]
    ids = tokens.Encoder.of(vocabulary(tokens.VOCABULARY))(pa.array(texts))
    assert ids == [e[:-1].astype("<u2").tobytes() for e in encoded(texts, 0)]
    part = pa.array(["no, no. ", *texts])[1:]
    assert tokens.Encoder.of(vocabulary(tokens.VOCABULARY))(part) == ids


def test_words_before_punctuation_are_encoded_once():
    encoder = tokens.Encoder(vocabulary(tokens.VOCABULARY))
    encoder(pa.array(["a word, a word. a word! a word's (word) été, été"]))
    assert set(encoder.place) == {"a", " a", " word", ",", ".", "!", "'s", " (word", ")", " été"}


def test_frequencies_count_all_ids(spark):
    rows = [(i, np.full(i % 7, i, "<u2").tobytes()) for i in range(2000)]
    counts = ans._counts(spark.createDataFrame(rows, "key long, ids binary").repartition(3), np.dtype("<u2"), 1 << 16)
    assert (counts[:2000] == np.arange(2000) % 7).all() and counts[2000:].sum() == 0


def test_worker_keeps_one_operators_memory():
    encoder = tokens.Encoder.of(vocabulary(tokens.VOCABULARY))
    assert tokens.Encoder.of(vocabulary(tokens.VOCABULARY)) is encoder
    gone = weakref.ref(encoder)
    del encoder
    langid.Pieces.of(vocabulary(langid.VOCABULARY))
    gc.collect()
    assert gone() is None


def check_pieces(pieces, documents):
    """Pieces (key, start, crc of ids, ...) make up the documents (key, ids), and windows have no gaps."""
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    wanted = {}
    for key, ids in documents:
        for p in packing.cut(len(ids), 2048, 512):
            wanted.setdefault((key, p[0], p[1], len(ids)), []).append(zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes()))
    got = {}
    for p in pieces:
        got.setdefault((p["doc_id"], p["start"], p["length"], p["doc_tokens"]), []).append(p["ids_crc32"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    return sum(p["length"] for p in pieces) / (2048 * len(windows))


def test_packing_of_given_documents(spark, given):
    pieces = result(spark, "op8_packing")
    assert check_pieces(pieces, zip(given, encoded(given.values(), 1))) > 0.97


def test_packing_of_odd_documents(odd, rows, empty):
    packed = packing.pack(odd, vocabulary(tokens.VOCABULARY)).withColumn("ids_crc32", F.crc32("ids"))
    check_pieces([r.asDict() for r in packed.collect()], [(k, i) for (k, *_), i in zip(rows, encoded([t for _, t, _ in rows], 1))])
    assert packing.pack(empty, vocabulary(tokens.VOCABULARY)).count() == 0


def test_differencing_is_even():
    sizes = np.random.default_rng(1).integers(1, 513, 600)
    for windows in (1, 2, 30, 90):
        chosen, sums = packing.difference(sizes, windows)
        assert sorted(np.bincount(chosen, sizes, windows)) == sorted(sums)
        assert sums.max() - sums.min() <= 0.05 * sums.mean() + 1
    assert len(packing.difference(np.array([5, 4]), 4)[0]) == 2


# Quality


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = fm.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) / len(found) > 0.97


def test_sum_of_squares_is_the_sum_over_pairs():
    machine = fm.Machine.new()
    index, value = np.array([3, 9, 40]), np.array([0.5, -1.0, 2.0], np.float32)
    v = machine.weights[index, 1:] * value[:, None]
    pairs = sum(v[i] @ v[j] for i in range(3) for j in range(i))
    assert abs(machine.raw(index, value, np.array([3]))[0][0] - (machine.weights[index, 0] @ value + pairs)) < 1e-5


def test_quality_of_odd_documents(spark, odd, rows, empty):
    labels = odd.select("doc_id", F.when(F.col("doc_id") > 5, 1).when(F.col("doc_id") > 2, 0).alias("quality"))
    found = fm.quality_scores(odd, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert fm.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in fm.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


# Vectors


def exact(vectors, k, every):
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in vectors.items() if i != q)[:k]
            out += [(q, rank, i) for rank, (_, i) in enumerate(scored, 1)]
    return out


def test_neighbours_of_given_vectors(spark):
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in frame.collect()}
    found = {(r["query_id"], r["vec_id"]) for r in result(spark, "op6_one_bit_search")}
    wanted = {(q, i) for q, _, i in exact(vectors, 20, 20)}
    assert len(found) == len(wanted) and len(found & wanted) / len(wanted) >= 0.9


def test_neighbours_over_several_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "ROWS", 64)
    monkeypatch.setattr(rabitq, "QUERIES", 8)
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=16) * rng.uniform(0.1, 9) for i in range(300)} | {300 + i: np.ones(16) for i in range(200)}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    vectors = {i: v.astype(np.float32).astype(float) for i, v in vectors.items()}
    found = {(r["query_id"], r["rank"], r["vec_id"]) for r in rabitq.nearest(frame).collect()}
    wanted = set(exact(vectors, 20, 20))
    assert len(found & wanted) / len(wanted) >= 0.95 and len(found) == len(wanted)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], "x"), (20, None, "x"), (2, [0.0, 0.0], "x"), (3, [float("nan"), 1.0], "x"), (4, [1.0, None], "x"),
        (5, [float("inf"), 1.0], "x"), (6, [1.0, 2.0], "x"), (6, [1.0, 2.0], "x"), (40, [0.5, 0.5], "x"), (7, [1.0], "x"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    found = [tuple(r) for r in rabitq.nearest(frame).collect()]
    assert sorted(found) == [
        (0, 1, 6, 1.0), (0, 2, 6, 1.0), (0, 3, 40, 0.5), (40, 1, 6, 1.5), (40, 2, 6, 1.5), (40, 3, 0, 0.5),
    ]
    assert rabitq.nearest(frame.limit(0)).count() == 0


def test_estimates_stay_within_their_bounds(monkeypatch):
    monkeypatch.setattr(rabitq, "WIDTH", 3.0)
    rng = np.random.default_rng(8)
    vectors, queries = rng.normal(size=(2000, 64)) + 0.3, rng.normal(size=(30, 64))
    centre, turn = vectors.mean(0), rabitq.rotation(64)
    index = rabitq.encode(vectors, centre, turn)
    assert index["code"].nbytes == 2000 * 8
    estimate, slack = rabitq.bounds(index, queries, centre, turn)
    assert (np.abs(estimate - queries @ vectors.T) <= slack).mean() > 0.99


@pytest.mark.parametrize("size", [1e-30, 1e-3, 1.0, 1e20, 1e150])
def test_neighbours_are_whole_at_any_scale(size):
    """All results at any scale, and few rows beside them ranked by their exact products."""
    rng = np.random.default_rng(4)
    vectors, ids = rng.normal(size=(4000, 64)) + 0.2, np.arange(4000)
    asked = ids % 20 == 0
    out = rabitq.search_block(
        ids, vectors * size, ids[asked], vectors[asked], vectors.mean(0) * size, rabitq.rotation(64), 20
    )
    products = vectors[asked] @ vectors.T
    products[ids[asked][:, None] == ids[None, :]] = -np.inf
    wanted = [set(np.argsort(-row)[:20]) for row in products]
    assert [len(found) for _, found, _ in out] == [20] * len(wanted)
    assert sum(len(set(found) & w) for (_, found, _), w in zip(out, wanted)) >= 0.95 * 20 * len(wanted)


def test_codes_leave_most_rows_out():
    """On the given vectors under three in ten rows are ranked exactly, at a recall above 0.95."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    vectors, ids = np.array(table["embedding"].to_pylist(), dtype=float), table["vec_id"].to_numpy()
    turn, centre, asked = rabitq.rotation(64), vectors.mean(0), ids % 20 == 0
    estimate, slack = rabitq.bounds(rabitq.encode(vectors, centre, turn), vectors[asked], centre, turn)
    products, found, ranked = vectors[asked] @ vectors.T, 0, 0
    for at, query in enumerate(ids[asked]):
        own = ids == query
        kept = rabitq.hopeful_rows(estimate[at], slack[at], own, lambda chosen: products[at][chosen], 20)
        best = np.argsort(-np.where(own, -np.inf, products[at]))[:20]
        found, ranked = found + len(np.intersect1d(best, kept)), ranked + len(kept)
    assert ranked < 0.3 * products.size and found > 0.95 * 20 * asked.sum()


def test_ids_that_are_null_or_repeat(spark):
    rows = [
        (None, [9.0, 9.0]), (0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [0.0, 3.0]), (2, [0.5, 0.5]),
    ]
    found = rabitq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in found) == sorted([
        (0, 1, 1, 2.0), (0, 2, 2, 0.5), (0, 3, 1, 0.0),  # of [1, 0], once
        (0, 1, 1, 3.0), (0, 2, 1, 1.0), (0, 3, 2, 0.5),  # of [0, 1]
    ])


def test_products_beyond_double_precision(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [-1e200, 0.0]), (3, [0.0, 2.0])]
    found = rabitq.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [
        (1, 1, float("inf")), (2, 3, 2.0), (3, 2, float("-inf")),
    ]


def test_header_is_little_endian():
    payload = ans.Coder(ans.scaled(np.ones(4))).encode(np.array([1, 2]))
    assert struct.unpack_from("<4sHHIIQ", payload)[:4] == (b"LRNS", 1, 256, 2)
