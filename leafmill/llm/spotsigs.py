"""SpotSigs document fingerprints.

A spot is an occurrence of a common word; its signature is that word with the
chain of the next ``CHAIN`` content words.  The set of a text's signatures is its
fingerprint, and two fingerprints are compared by their Jaccard likeness.  Common
words are marked by one regular expression, spots are taken by another with a
look-ahead, so everything stays in the JVM and no text is exploded.

``similar`` compares all documents: sets are partitioned by length, so that only
sets of lengths that allow the threshold meet, on signatures of their rare-first
prefixes, and are compared once.

Only DataFrame functions are used.

Cases: null text is empty; texts without a spot but with other characters have
one signature, that of the whole text; empty texts have none, and two empty
sets are alike (1.0); rows with equal key and text are one place in the order of
``with_next``; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.components import connected_components
from leafmill.session import store

CHAIN = 2
# Common words of four languages.
COMMON = (
    "the a an of and to in is are was were be it that this for on with as at by from"
    " le la les de du des et un une en que qui pour dans au aux est sur par pas avec"
    " der die das und ist ein eine zu den von mit im auf dem nicht sich"
    " el los las y por con para del se al lo su es"
).split()
MARK = "\u0001"
# Common words that may stand between an anchor and its chain.
GAP = 20


def _common() -> str:
    by_letter: dict[str, list[str]] = {}
    for word in dict.fromkeys(COMMON):
        by_letter.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())


def with_signatures(frame: DataFrame, text: str, out: str) -> DataFrame:
    """The distinct signatures of a text, sorted, as 32-bit numbers, in a new column."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    plain = F.regexp_replace(plain, "  +", " ")
    marked = F.regexp_replace(plain, f" (?=(?:{_common()}) )", f" {MARK}")
    skip, content = f"(?: {MARK}[^ ]++){{0,{GAP}}}+", f" [^ {MARK}][^ ]*+"
    spots = F.regexp_extract_all(marked, F.lit(f"(?=({MARK}[^ ]++(?:{skip}{content}){{{CHAIN}}}))"), 1)
    hashed = F.transform(
        spots, lambda s: F.hash(F.regexp_replace(s, f" {MARK}[^ ]+", ""))
    )
    # A step of its own: what follows uses it several times.
    found = frame.withColumn("__found", F.array_sort(F.array_distinct(hashed)))
    whole, none = F.array(F.hash(text)), F.array().cast("array<int>")
    chosen = F.when(F.size("__found") > 0, F.col("__found")).when(F.length(text) > 0, whole).otherwise(none)
    return found.withColumn(out, chosen).drop("__found")


def fingerprint(sigs: Column) -> Column:
    digits = F.transform(sigs, lambda s: F.lower(F.lpad(F.right(F.hex(s), F.lit(8)), 8, "0")))
    return F.array_join(digits, "")


def likeness(one: Column, two: Column) -> Column:
    """Jaccard likeness of two sets; of two empty ones 1."""
    common = F.size(F.array_intersect(one, two))
    both = F.size(one) + F.size(two) - common
    return F.when(both == 0, 1.0).otherwise(common / both)


def next_in_order(keys: DataFrame) -> DataFrame:
    """Distinct (id, at) with the next one in descending order as (next_id, next_at); the last has the first.

    Ranges of the order are numbered side by side; only their first rows meet.
    """
    order = [F.desc_nulls_last("id"), F.asc("at")]
    spread = store(
        keys.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order"
    )
    own = W.partitionBy("part").orderBy(*order)
    this = F.struct("id", "at")
    rows = spread.withColumn("nth", F.row_number().over(own)).withColumn("following", F.lead(this).over(own))
    # One row per range.
    heads = rows.filter("nth = 1").select("part", this.alias("head"))
    by_part = W.orderBy("part")
    whole = by_part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select(
        "part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(whole)).alias("beyond")
    )
    following = F.coalesce("following", "beyond")
    return rows.join(heads, "part").select(
        "id", "at", following["id"].alias("next_id"), following["at"].alias("next_at")
    )


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the fingerprints of its text and of its edited text, and two likenesses.

    The edited text has its last third replaced by as much of the beginning of
    the next document, in descending order of the key.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    # What tells rows apart: the key, and a hash of the text whose last bit says that the key is null.
    rows = rows.withColumn("nid", F.coalesce("id", F.lit(0).cast(kind))).withColumn(
        "at", F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.isnull("id").cast("long"))
    )
    keys = rows.select("id", "nid", "at", F.floor(F.length("text") / 3).alias("third")).distinct()
    keys = store(keys, "order-keys")
    order = next_in_order(keys.select("id", "at")).withColumn("nid", F.coalesce("id", F.lit(0).cast(kind)))
    wanted = order.join(keys.drop("id"), ["nid", "at"]).select(
        F.col("nid").alias("for_nid"), F.col("at").alias("for_at"), "third",
        F.coalesce("next_id", F.lit(0).cast(kind)).alias("nid"), F.col("next_at").alias("at"),
    )
    heads = with_signatures(rows.drop("id").join(wanted, ["nid", "at"]), "text", "next_sigs").select(
        "for_nid", "for_at", F.expr("substring(text, 1, third)").alias("head"), "next_sigs"
    )
    # Equal rows bring equal beginnings: one is enough.
    heads = heads.groupBy(F.col("for_nid").alias("nid"), F.col("for_at").alias("at")).agg(
        F.first("head").alias("head"), F.first("next_sigs").alias("next_sigs")
    )
    edited = F.concat(F.expr("substring(text, 1, n_chars - n_chars div 3)"), F.col("head"))
    joined = (
        rows.drop("id").join(heads, ["nid", "at"])
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", edited)
    )
    joined = with_signatures(with_signatures(joined, "text", "sigs"), "edited", "edited_sigs")
    joined = joined.select(
        F.when(F.col("at").bitwiseAND(F.lit(1)) == 0, F.col("nid")).alias("id"), "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_sigs", "sigs", "edited_sigs",
    )
    return joined.select(
        F.col("id").alias(key), "n_chars", "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and class_id, the smallest key that its fingerprint is linked to.

    Sets whose likeness reaches the threshold link; empty ones with nothing.
    Equal sets are one.  Sets are partitioned by length: with ratio 1/threshold
    from one partition to the next, only neighbours can be alike enough.  In a
    partition, sets meet on the signatures of their rare-first prefixes: first
    each with the smallest set there, then those whose classes still differ.
    """
    named = with_signatures(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", "sigs")
    named = store(named.select("key", "sigs", F.xxhash64("sigs").alias("set")), "spots")
    sets = named.filter("size(sigs) > 0").groupBy("set").agg(F.first("sigs").alias("sigs"))
    sets = store(sets.withColumn("n", F.size("sigs")), "spot-sets")
    spread = sets.select("set", "n", F.explode("sigs").alias("sig"))
    known = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"))
    rank = F.row_number().over(W.partitionBy("set").orderBy("sets", "sig"))
    part = F.floor(F.log("n") / F.log(F.lit(1 / threshold)))
    index = (
        spread.join(known, "sig").withColumn("rank", rank)
        .filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
        .filter("sets > 1")
        .withColumn("part", F.explode(F.array(part, part + 1)))
        .select("sig", "part", "set", "n")
    )
    index = store(index, "spot-index")
    centre = index.groupBy("sig", "part").agg(F.min("set").alias("centre"))
    met = index.join(centre, ["sig", "part"])
    first = _linked(met.filter("set <> centre").select(F.col("centre").alias("a"), F.col("set").alias("b")), sets, threshold)
    labels = connected_components(first)
    own = labels.select(F.col("id").alias("set"), F.col("label").alias("own"))
    main = labels.select(F.col("id").alias("centre"), F.col("label").alias("main"))
    classed = (
        met.join(own, "set", "left").join(main, "centre", "left")
        .select("sig", "part", "set", F.coalesce("own", "set").alias("own"), F.coalesce("main", "centre").alias("main"))
    )
    outside = classed.filter("own <> main").select("sig", "part", F.col("set").alias("b"), F.col("own").alias("theirs"))
    crossing = classed.join(outside, ["sig", "part"]).filter("own <> theirs").select(
        F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b")
    )
    labels = connected_components(first.union(_linked(crossing, sets, threshold)))
    joined = named.join(labels.withColumnRenamed("id", "set"), "set", "left")
    label = F.when(F.size("sigs") > 0, F.coalesce("label", "set"))
    joined = joined.select("key", label.alias("label"))
    smallest = joined.filter("label is not null").groupBy("label").agg(F.min("key").alias("class_id"))
    return joined.join(smallest, "label", "left").select(
        F.col("key").alias(key), F.when(F.col("label").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id")
    )


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) that are alike enough; lengths are tested before sets are compared."""
    one = sets.select(F.col("set").alias("a"), F.col("sigs").alias("sigs_a"), F.col("n").alias("n_a"))
    two = sets.select(F.col("set").alias("b"), F.col("sigs").alias("sigs_b"), F.col("n").alias("n_b"))
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    joined = pairs.distinct().join(one, "a").join(two, "b").filter(near)
    return store(
        joined.filter(likeness(F.col("sigs_a"), F.col("sigs_b")) >= threshold - 1e-12).select("a", "b"), "spot-links"
    )
