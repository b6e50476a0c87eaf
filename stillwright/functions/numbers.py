"""Arithmetic on doubles as the queries' SQL has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int) -> Column:
    """A double at so many decimals: its product with a power of ten at the nearest whole number, halves away from zero.

    Spark's own round goes by the shortest decimal text of a double. Where that is near a half at the next place the
    product can fall on the other side, and two scores that SQL has equal differ, or the other way round.
    """
    value, scale = (F.col(x) if isinstance(x, str) else x).cast("double"), 10.0**places
    return F.round(value * scale, 0) / scale
