"""Names for values inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once, however often the body asks for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
