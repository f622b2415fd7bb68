"""Unnesting of computed arrays.

For a plain ``explode`` Spark infers the filter ``size(array) > 0`` and moves it towards the
scan, which evaluates the array expression twice (and, below a repartitioning, on fewer
cores).  The outer form plus a null test afterwards gives the same rows in one evaluation.
Arrays handed in here hold no null elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(rows: DataFrame, array: Column | str, name: str, *keep) -> DataFrame:
    """One row per element."""
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def each_placed(rows: DataFrame, array: Column | str, pos: str, name: str, *keep) -> DataFrame:
    """One row per element with its 0-based place."""
    placed = rows.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return placed.where(F.col(pos).isNotNull())


def each_struct(rows: DataFrame, array: Column | str, present: str, *keep) -> DataFrame:
    """One row per struct, its fields as columns; field ``present`` is never null."""
    return rows.select(*keep, F.inline_outer(array)).where(F.col(present).isNotNull())


def named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
