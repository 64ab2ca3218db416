"""A corpus from raw documents: stages that each apply one operator of ``leafmill.llm``.

Every stage but the last returns the columns of ``documents``; ``run`` writes each
stage's rows as Parquet to the shared folder and gives them to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import langid, mixing, ngram_join, packing, recompression, tokens
from leafmill.llm.common import documents
from leafmill.llm.queries import vocabulary
from leafmill.session import prepare, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose best language has under half of the probability."""
    prepare(spark)
    model = langid.fit(docs, vocabulary(langid.VOCABULARY))
    found = langid.identify(docs.select(*COLUMNS), model, out=("__lang", "__score"))
    kept = (F.col("__lang") != langid.UNKNOWN_LANGUAGE) & (F.col("__score") >= 0.5)
    return found.filter(kept).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of texts that share 0.8 of their five-word shingles.

    It is the row of the smallest doc_id, null last; of several, the one with
    the smallest hash of all columns; of equal rows, one.  Rows without words
    are in no class and stay.
    """
    prepare(spark)
    rows = docs.select(*COLUMNS)
    # Nulls leave the hash as it is, so where they are is hashed too.
    rows = rows.withColumn("__rid", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))
    keyed = rows.withColumn("__key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__rid"))
    classes = ngram_join.ngram_components(keyed, n=5, percent=80, key="__key")
    chosen = (
        classes.filter(F.col("__key") == F.col("component_id"))
        .groupBy(F.col("__key")["__rid"].alias("__rid"))
        .agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n"))
    )
    chosen = store(chosen, "near-duplicates-kept")
    single = rows.join(chosen.filter("rows = 1 or n = 0"), "__rid", "left_semi").select(*COLUMNS)
    # Equal rows are made one where they are read, before they meet in a task.
    equal = rows.join(chosen.filter("rows > 1 and n > 0"), "__rid", "left_semi").select(*COLUMNS)
    return single.union(equal.distinct())


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words that occur elsewhere; texts without one stay as they are."""
    prepare(spark)
    left = recompression.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return left.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    prepare(spark)
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in windows of 2048 tokens."""
    prepare(spark)
    packed = packing.pack(docs, vocabulary(tokens.VOCABULARY), capacity=2048, end_id=1)
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("packing", pack_windows),
]

# No stage but the mix's targets can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(prepare(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
