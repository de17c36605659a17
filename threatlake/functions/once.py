"""A value that is worked out once, however often an expression names it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value). Spark works out a plain expression again wherever a branch or a lambda names
    it; here it is the one item of an array, which the lambda reads."""
    return F.get(F.transform(F.array(value), of), F.lit(0))
