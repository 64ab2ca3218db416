"""Plans made from the prompt alone, as expressions on the prompt column.

Rules and targets are literals inside the expression, so planning a table of
prompts is one projection: no join, no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.urls import netloc
from leafmill.plans import fixed

TARGET = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("expected_elements", T.ArrayType(T.StringType())),
    ]
)
PLAN = T.StructType(
    [
        T.StructField("project_description", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("urls", T.ArrayType(TARGET)),
        T.StructField("target_columns", T.ArrayType(T.StringType())),
        T.StructField("scraping_strategy", T.StringType()),
        T.StructField("estimated_rows", T.StringType()),
    ]
)


def _first_rule(lowered: Column) -> Column:
    rule = None
    for name, words in fixed.RULES:
        hit = F.contains(lowered, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(lowered, F.lit(word))
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return rule.otherwise(fixed.GENERAL)


def route(prompts: DataFrame) -> DataFrame:
    """Add `rule`: the first rule one of whose words occurs in the prompt, in any case.

    The lowered prompt is a column of its own, so that a long prompt is lowered
    once and not for each of the words.
    """
    lowered = prompts.withColumn("_lowered", F.lower("prompt"))
    return lowered.withColumn("rule", _first_rule(F.col("_lowered"))).drop("_lowered")


def topic(prompt: Column, length: int | None = fixed.TOPIC_LENGTH) -> Column:
    flat = F.replace(prompt, F.lit(" "), F.lit("_"))
    return flat if length is None else F.substring(flat, 1, length)


def _fill(template: str, mark: str, value: Column) -> Column:
    """A template with its `mark` replaced."""
    before, after = template.split(mark)
    return F.concat(F.lit(before), value, F.lit(after))


def paged_targets(rule: str) -> Column:
    """The one target of a paged rule, once for each page number."""
    ((url, name, description, expected),) = fixed.TARGETS[rule]
    return F.transform(
        F.sequence(F.lit(1), F.lit(fixed.PAGE_COUNT)),
        lambda n: F.struct(
            _fill(url, "{n}", n.cast("string")).alias("url"),
            _fill(name, "{n}", n.cast("string")).alias("source_name"),
            F.lit(description).alias("description"),
            F.array(*[F.lit(e) for e in expected]).alias("expected_elements"),
        ),
    )


def listed_targets(rule: str, prompt: Column) -> Column:
    """The fixed targets of a rule; a literal that the optimizer folds to an array."""
    names = TARGET.names
    listed = [dict(zip(names, target)) for target in fixed.TARGETS[rule]]
    array = F.from_json(F.lit(json.dumps(listed)), PLAN["urls"].dataType)
    if rule != fixed.GENERAL:
        return array
    return F.transform(
        array,
        lambda t: F.struct(
            F.replace(t["url"], F.lit("{topic}"), topic(prompt)).alias("url"),
            t["source_name"].alias("source_name"),
            F.replace(t["description"], F.lit("{prompt}"), prompt).alias("description"),
            t["expected_elements"].alias("expected_elements"),
        ),
    )


def targets(prompt: Column, rule: Column) -> Column:
    """All targets of a prompt, in plan order."""
    chosen = None
    for name in fixed.TARGETS:
        paged = name in fixed.PAGED_RULES
        value = paged_targets(name) if paged else listed_targets(name, prompt)
        chosen = F.when(rule == name, value) if chosen is None else chosen.when(rule == name, value)
    return chosen


def prompt_plan(prompt: Column, rule: Column) -> Column:
    """The whole plan (`PLAN`) a prompt gets when no model has answered it."""
    return F.struct(
        F.concat(F.lit(fixed.PROJECT_PREFIX), prompt).alias("project_description"),
        F.lit(fixed.DATA_TYPE).alias("data_type"),
        targets(prompt, rule).alias("urls"),
        F.array(*[F.lit(c) for c in fixed.TARGET_COLUMNS]).alias("target_columns"),
        F.lit(fixed.STRATEGY).alias("scraping_strategy"),
        F.lit(fixed.ESTIMATED_ROWS).alias("estimated_rows"),
    )


def catalog(spark: SparkSession) -> DataFrame:
    """The catalogue of sources, 26 rows."""
    return spark.createDataFrame(
        fixed.CATALOG, "category string, url_template string, description string"
    )


def page_categories(pages: DataFrame) -> DataFrame:
    """`(url, ...)` with the catalogue's ``category`` of its host, NULL for other hosts.

    A host with entries in several categories has the first of them by name.
    """
    hosts = (
        catalog(pages.sparkSession)
        .groupBy(netloc(F.col("url_template")).alias("_host"))
        .agg(F.min("category").alias("category"))
    )
    # At most one row per entry of the catalogue.
    known = F.broadcast(hosts)
    return pages.withColumn("_host", netloc(F.col("url"))).join(known, "_host", "left").drop("_host")
