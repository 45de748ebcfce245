"""Bind a value once inside a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Inside the lambda of a higher-order function a plain expression would be computed again for
    every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
