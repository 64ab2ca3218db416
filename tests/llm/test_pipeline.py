"""The pipeline's stages: each works on what the one before kept, and its decisions take effect."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    junk = spark.createDataFrame([(10_000, "12 34 !!", "en", "src1", 8), (10_001, None, None, None, 0)], docs.schema)
    docs = docs.union(junk)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        made = spark.read.parquet(f"{folder}/{name}")
        out[name], docs = (docs, made), made
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS, name


def test_language_rejects_texts_without_letters(stages):
    before, after = stages["language_id"]
    assert set(texts(before)) - set(texts(after)) == {10_000, 10_001}


def test_one_of_each_group_stays(stages):
    before, after = map(texts, stages["ngram_jaccard_join"])
    keys = sorted(before)
    labels = brute.components([brute.shingles(before[k], 5) for k in keys], 80)
    assert sorted(after) == sorted({keys[l] for l in labels})


def test_repeats_go(stages):
    before, after = map(texts, stages["substring_dedup"])
    keys = list(before)
    for key, (words, left) in zip(keys, brute.kept_after_repeats([before[k] for k in keys], 35)):
        assert after[key] == (before[key] if len(words) == len(left) else " ".join(left))


def test_mix_repeats_documents(stages):
    before, after = stages["mix_sources"]
    sizes = {r["doc_id"]: len(brute.words(r["text"])) for r in before.collect()}
    times = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert set(times) <= set(sizes) and set(times.values()) <= {1, 2}
    assert abs(sum(sizes[k] * n for k, n in times.items()) / sum(sizes.values()) - 1.5) < 0.03


def test_all_is_packed(stages):
    before, after = stages["packing"]
    rows = before.groupBy("doc_id").count().collect()
    whole = after.groupBy("doc_id").agg((F.sum("length") / F.max("doc_tokens")).alias("times")).collect()
    assert {r["doc_id"]: r["count"] for r in rows} == {r["doc_id"]: r["times"] for r in whole}


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    other = "a quite different text about something else that nobody has copied yet"
    third = "yet another text of which all the copies have lost their key"
    rows = [
        (1, text, "en", "s0", 5), (1, text, "en", "s0", 5), (1, text, "en", "s0", 5),  # repeated rows
        (1, other, "en", "s0", 5),  # a clean row of the same doc_id
        (None, text, "en", "s0", 5), (2, other, "en", "s0", 5), (None, other, "en", "s1", 5),  # copies
        (None, third, "en", None, 5), (None, third, None, "en", 5), (None, third, "en", None, 5),  # null ids only
        (None, "", "en", "s0", 0), (None, "", "en", "s0", 0), (7, None, None, None, None),  # no words
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), FOLDER)
    assert left.columns == corpus_pipeline.COLUMNS
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert kept == sorted([(1, text), (1, other), (None, third), (None, ""), (None, ""), (7, None)], key=str)
