"""Cleaned bags as delimited text, one folder per category.

Version 1 lines read ``W1,W2-D1,D2``; version 2 lines hold four ``;``-separated lists
(words, stemmed words, definition, stemmed definition).  Normalised tokens contain none of
the delimiters.  Parquet is the better store; these formats exist to exchange data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

V2_FIELDS = ("words", "words_stem", "defs", "defs_stem")


def _write(lines: DataFrame, path: str, codec: str, files: int | None) -> None:
    if files:
        lines = lines.coalesce(files)
    lines.write.partitionBy("category").option("compression", codec).text(path)


def write_v1(bags: DataFrame, path: str, codec: str = "bzip2", files: int | None = None) -> None:
    line = F.concat_ws("-", F.array_join("words", ","), F.array_join("defs", ","))
    _write(bags.select("category", line.alias("value")), path, codec, files)


def read_v1(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "-", 2)
    return (
        spark.read.schema("value string, category string").text(path)
        .select(
            "category",
            F.split(F.get(parts, F.lit(0)), ",").alias("words"),
            F.split(F.get(parts, F.lit(1)), ",").alias("defs"),
        )
    )


def write_v2(bags: DataFrame, path: str, codec: str = "bzip2", files: int | None = None) -> None:
    line = F.concat_ws(";", *[F.array_join(field, ",") for field in V2_FIELDS])
    _write(bags.select("category", line.alias("value")), path, codec, files)


def read_v2(spark: SparkSession, path: str) -> DataFrame:
    fields = F.split("value", ";")
    return (
        spark.read.schema("value string, category string").text(path)
        .select(
            "category",
            *[F.split(F.get(fields, F.lit(n)), ",").alias(name) for n, name in enumerate(V2_FIELDS)],
        )
    )


def write_stem_index(index: DataFrame, path: str, codec: str = "bzip2") -> None:
    index.select(F.concat_ws(",", "stem", "form").alias("value")).write.option(
        "compression", codec
    ).text(path)


def read_stem_index(spark: SparkSession, path: str) -> DataFrame:
    """``(stem, form)``; the line is cut at its first comma only."""
    parts = F.split("value", ",", 2)
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("stem"), F.get(parts, F.lit(1)).alias("form")
    )
