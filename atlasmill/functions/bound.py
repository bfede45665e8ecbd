"""Names for values within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: an expression that is named twice in Python is computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
