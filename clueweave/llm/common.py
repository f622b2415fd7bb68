"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def two_hashes(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns: together a key without practical collisions.

    Nulls hash too, so the key is never null.
    """
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)


def texts_of(column: pa.Array, limit: int = 1 << 22) -> Iterator[list[str | None]]:
    """The strings of an Arrow column in runs of about ``limit`` characters (one at least)."""
    run, size = [], 0
    for value in column:
        text = value.as_py()
        run.append(text)
        size += len(text or "")
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run
