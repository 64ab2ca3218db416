"""Connected components of a table of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import store


def connected_components(links: DataFrame) -> DataFrame:
    """``id`` and ``label`` for every end of a link (a, b); the label is the smallest id.

    Each round hooks every class to its smallest neighbour, follows the hooks to
    their ends, and goes on with the links between the merged classes.  At
    least every second class that has a link disappears in a round, so the
    number of rounds is logarithmic.  Each step is a table in the shared
    folder; hubs are only ever aggregated or on the split side of a join.
    """
    links = store(_between(links), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("to")).select(
            F.col("a").alias("id"), F.least("a", "to").alias("label")
        )
        hooks = _ends(store(hooks, "hooks"))
        links = store(_between(_renamed(_renamed(links, hooks, "a"), hooks, "b")), "links")
        labels = hooks if labels is None else store(_renamed(labels, hooks, "label"), "labels")
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels


def _between(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def _renamed(frame: DataFrame, hooks: DataFrame, column: str) -> DataFrame:
    new = hooks.select(F.col("id").alias(column), F.col("label").alias("__new"))
    return frame.join(new, column, "left").withColumn(
        column, F.coalesce("__new", column)
    ).select(*frame.columns)


def _ends(hooks: DataFrame) -> DataFrame:
    while True:
        on = hooks.select(F.col("id").alias("label"), F.col("label").alias("end"))
        moved = hooks.join(on, "label", "left").select(
            "id", F.coalesce("end", "label").alias("label"), (F.col("end") < F.col("label")).alias("moved")
        )
        moved = store(moved, "hooks")
        hooks = moved.select("id", "label")
        if moved.filter("moved").isEmpty():
            return hooks
