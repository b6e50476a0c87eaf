"""Vector and bit expressions; inputs are cast to double, so results don't depend on the storage type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sign_hash(v: Column) -> Column:
    """64 comparisons packed into a bigint: bit i is set where element i is above 0."""
    return F.aggregate(F.transform(F.slice(v, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def difference_hash(rows: Column) -> Column:
    """Difference hash of an 8 x 9 grid of grey values (array of rows): bit 8 y + x is set where a cell is brighter than its left neighbour."""
    bits = F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: F.get(r, x) > F.get(r, x - 1))))
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def spread_ratio(points: Column, first: int, count: int, width: Column, missing: float) -> Column:
    """Height of `count` landmarks from the `first` (0-based) on, over a width; `missing` without landmarks or width."""
    ys = F.transform(F.slice(points, first + 1, count), lambda p: p[1].cast("double"))
    return F.when(points.isNull() | (F.size(points) < first + count) | (width <= 0), F.lit(missing)).otherwise((F.array_max(ys) - F.array_min(ys)) / width)


def lip_gap(points: Column, width: Column) -> Column:
    """Inner lip height over mouth width; 1.0 without landmarks."""
    return spread_ratio(points, 64, 8, width, 1.0)


def mouth_open(points: Column, width: Column) -> Column:
    """Outer lip height over mouth width; 0.5 without landmarks."""
    return spread_ratio(points, 52, 12, width, 0.5)
