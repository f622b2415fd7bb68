"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def scale(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def argmax(a: Column) -> Column:
    """0-based place of the largest element, the first on ties, -1 when empty."""
    return F.when(F.size(a) == 0, F.lit(-1)).otherwise(
        (F.array_position(a, F.array_max(a)) - 1).cast("int")
    )
