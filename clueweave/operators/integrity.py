"""Key reports and cascading deletes for tables that cannot enforce constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def primary_keys(checks: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """``(constraint, violations)``: key values that occur more than once or hold a null."""

    def check(name, rows, keys):
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        bad = F.when((F.col("n") > 1) | some_null, 1).otherwise(0).cast("bigint")
        return counts.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("violations")).select(
            F.lit(name).alias("constraint"), "violations"
        )

    return reduce(DataFrame.unionByName, [check(*c) for c in checks])


def foreign_keys(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """``(constraint, violations)``: child rows whose key has no parent."""

    def check(name, child, key, parent, parent_key):
        # children are counted per key first, so a key shared by many rows is one row
        counts = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
            F.count(F.lit(1)).alias("n")
        )
        orphans = counts.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
        return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
            F.lit(name).alias("constraint"), "violations"
        )

    return reduce(DataFrame.unionByName, [check(*c) for c in checks])


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows left after their parents in ``deleted`` went away."""
    return child.join(deleted.select(key), key, "left_anti")
