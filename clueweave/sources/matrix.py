"""Adjacency and index files, and sparse feature rows printed as tuples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_adjacency(adjacency: DataFrame, path: str, codec: str = "bzip2") -> None:
    adjacency.select("wid_from", "wid_to", "weight").write.csv(path, compression=codec)


def write_index(dictionary: DataFrame, path: str, codec: str = "bzip2") -> None:
    dictionary.select("wid", "word").write.csv(path, compression=codec)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``(wid_from, wid_to, weight)``; header rows do not parse and are left out."""
    schema = "wid_from bigint, wid_to bigint, weight double"
    return spark.read.schema(schema).csv(path).where("wid_from IS NOT NULL AND wid_to IS NOT NULL")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("wid bigint, word string").csv(path).where("wid IS NOT NULL")


def parse_sparse(lines: DataFrame) -> DataFrame:
    """Lines ``(row,[i, ..],[v, ..])`` -> ``(i, j, v)``; indices start at 1, repeats add up."""
    ints = r"^\((\d+),\[([^\]]*)\],\[([^\]]*)\]\)"
    parts = lines.select(
        F.regexp_extract("value", ints, 1).try_cast("bigint").alias("i"),
        F.split(F.regexp_extract("value", ints, 2), " *, *").alias("js"),
        F.split(F.regexp_extract("value", ints, 3), " *, *").alias("vs"),
    )
    cells = parts.select("i", F.inline(F.arrays_zip("js", "vs"))).select(
        "i", F.trim("js").try_cast("bigint").alias("j"), F.trim("vs").try_cast("double").alias("v")
    )
    return cells.where("i > 0 AND j > 0").groupBy("i", "j").agg(F.sum("v").alias("v"))


def parse_reduced(lines: DataFrame) -> DataFrame:
    """Lines ``(List(w, ..),List(d, ..),weight)`` -> ``(words, defs, weight)``."""
    shape = r"^\(\w+\(([^)]*)\),\w+\(([^)]*)\),([^)]*)\)"
    return lines.select(
        F.split(F.regexp_extract("value", shape, 1), ", ").alias("words"),
        F.split(F.regexp_extract("value", shape, 2), ", ").alias("defs"),
        F.regexp_extract("value", shape, 3).try_cast("double").alias("weight"),
    )
