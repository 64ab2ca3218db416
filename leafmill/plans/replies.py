"""Plans read from stored model replies, and tables of plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.bind import bound
from leafmill.functions.text import SPACE
from leafmill.operators.extract import default_source
from leafmill.plans.routing import PLAN, TARGET, prompt_plan, route
from leafmill.session import prepare

_FENCE = "```"
# How an explicit null is shown.
_NULL = "None"
_NOT_NUMBERS = ('"NaN"', '"Infinity"', '"-Infinity"')
_TARGET_SCALARS = [f.name for f in TARGET if f.dataType.simpleString() == "string"]


def strip_fences(reply: Column) -> Column:
    """A reply without the code fence it may be wrapped in.

    Only a reply that begins with a fence is touched.
    """
    trimmed = _strip(reply)
    opened = F.regexp_replace(trimmed, rf"^{_FENCE}(?:json)?{SPACE}*", "")
    bare = F.regexp_replace(opened, rf"\n?{_FENCE}\z", "")
    return _strip(F.when(F.startswith(trimmed, F.lit(_FENCE)), bare).otherwise(trimmed))


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+\z", "")


def _from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"allowSingleQuotes": "false"})


def _names(text: Column) -> Column:
    """The member names of a JSON object; NULL when the text is not just that.

    A reader stops after the value it was asked for.  As the one element of an
    array and as the one member of an object, the text must end where its value
    does: what one form lets through closes the other too early.
    """
    alone = _from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    member = _from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v map<string,string>")["v"]
    return F.when(F.size(alone) == 1, F.map_keys(member))


def _fields(text: Column, names: Sequence[str]) -> Column:
    """Members as texts, values that are not texts as JSON; of repeated names the last counts."""
    return _from_json(text, ", ".join(f"{name} string" for name in names))


def _listed(text: Column, name: str, raw: Column) -> Column:
    """A member that is an array, its entries as texts; NULL when it is something else.

    ``raw``: the member as a text, which is that of its last mention.
    """
    return F.when(F.startswith(raw, F.lit("[")), _from_json(text, f"{name} array<string>")[name])


def _texts(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.coalesce(e, F.lit(_NULL)))


def _countable(text: Column, raw: Column, listed: Column) -> Column:
    """Whether a value that is there, `urls`, has a length: an array, an object or a text."""
    number = F.rlike(raw, F.lit(r"^-?[0-9]")) & _from_json(text, "urls double")["urls"].isNotNull()
    is_number = number | raw.isin(*_NOT_NUMBERS)
    is_truth = raw.isin("true", "false") & _from_json(text, "urls boolean")["urls"].isNotNull()
    return (
        F.when(listed.isNotNull() | F.startswith(raw, F.lit("{")), True)
        .when(raw.isNull(), False)
        .otherwise(~is_number & ~is_truth)
    )


def _target(entry: Column) -> Column:
    return bound(
        _fields(entry, TARGET.names),
        lambda found: F.struct(
            *[found[name].alias(name) for name in _TARGET_SCALARS],
            _texts(_listed(entry, "expected_elements", found["expected_elements"])).alias("expected_elements"),
        ),
    )


def _plan(text: Column, names: Column, found: Column, listed: Column) -> Column:
    """The plan of a reply with these member names, texts and entries of `urls`."""

    def named(name: str) -> Column:
        return F.array_contains(names, F.lit(name))

    objects = F.filter(
        F.coalesce(listed, F.array().cast("array<string>")), lambda e: F.startswith(e, F.lit("{"))
    )
    columns = _texts(_listed(text, "target_columns", found["target_columns"]))
    parts = {"urls": F.transform(objects, _target), "target_columns": columns}
    fields = [
        parts.get(name, F.when(named(name), F.coalesce(found[name], F.lit(_NULL)))).alias(name) for name in PLAN.names
    ]
    return F.when(~named("urls") | _countable(text, found["urls"], listed), F.struct(*fields))


def reply_plan(reply: Column) -> Column:
    """The plan of a reply; NULL when the reply is not one strict JSON object with countable URLs.

    All of it is Spark's own JSON functions.  Values that are not texts are kept
    as JSON (``true``, ``[1, 2]``), an explicit null as ``None``; half a surrogate
    pair reads ``?``.  Entries of ``urls`` that are not objects are left out (a text
    that is itself an object in JSON counts as one).  Of repeated names the last counts.
    """

    def read(text: Column, names: Column) -> Column:
        return bound(
            _fields(text, PLAN.names),
            lambda found: bound(
                _listed(text, "urls", found["urls"]), lambda listed: _plan(text, names, found, listed)
            ),
        )

    return bound(
        strip_fences(reply),
        lambda text: bound(_names(text), lambda names: F.when(names.isNotNull(), read(text, names))),
    )


def plans(prompts: DataFrame) -> DataFrame:
    """`(prompt_id, prompt [, raw_response])` to `(prompt_id, prompt, plan, planned_by)`.

    A prompt without a usable reply is planned by its own words.
    """
    prepare(prompts.sparkSession)
    prompts = route(prompts)
    fallback = prompt_plan(F.col("prompt"), F.col("rule"))
    if "raw_response" not in prompts.columns:
        return prompts.select(
            "prompt_id", "prompt", fallback.alias("plan"), F.lit("rules").alias("planned_by")
        )
    read = reply_plan(F.col("raw_response")).alias("read")
    return prompts.select("prompt_id", "prompt", "rule", read).select(
        "prompt_id",
        "prompt",
        F.coalesce("read", fallback).alias("plan"),
        F.when(F.col("read").isNull(), "rules").otherwise("reply").alias("planned_by"),
    )


def plan_summary(planned: DataFrame) -> DataFrame:
    """The header of each plan as it is shown, with N/A for what is missing."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col("plan")[name], F.lit("N/A"))

    return planned.select(
        "prompt_id",
        shown("project_description").alias("project"),
        shown("data_type").alias("data_type"),
        shown("scraping_strategy").alias("strategy"),
        shown("estimated_rows").alias("estimated_rows"),
        F.coalesce(F.array_join("plan.target_columns", ", "), F.lit("")).alias("columns"),
        _url_count().alias("url_count"),
    )


def _url_count() -> Column:
    # The size of NULL depends on the session's ANSI mode.
    return F.when(F.col("plan.urls").isNull(), 0).otherwise(F.size("plan.urls")).cast("bigint")


def plan_urls(planned: DataFrame) -> DataFrame:
    """One row per planned URL, numbered from 1, with defaults filled in.

    The outer form keeps Spark from testing the size of the array first, for
    which it would build every plan a second time.
    """
    exploded = planned.select(
        "prompt_id", F.posexplode_outer("plan.urls").alias("at", "target")
    ).filter(F.col("at").isNotNull())
    url = F.coalesce(F.col("target.url"), F.lit(""))
    return exploded.select(
        "prompt_id",
        (F.col("at") + 1).cast("bigint").alias("pos"),
        url.alias("url"),
        default_source(url, F.col("target.source_name")).alias("source_name"),
        F.coalesce(F.col("target.description"), F.lit("")).alias("description"),
        F.col("target.expected_elements").alias("expected_elements"),
    )


def empty_plans(planned: DataFrame) -> DataFrame:
    """Prompts whose plan names no URL."""
    return planned.filter(_url_count() == 0).select("prompt_id", "planned_by")
