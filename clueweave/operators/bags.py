"""Category bags: (word, text) pairs, cleaned entries and category weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueweave.functions import text as T
from clueweave.operators.unnest import each, each_struct

# Category weights in tenths, first and second graph version.
WEIGHTS_V1 = {"clues": 10, "definitions": 6, "examples": 6, "equivalents": 4, "associated": 1}
WEIGHTS_V2 = {"clues": 4, "definitions": 5, "examples": 1, "equivalents": 10, "associated": 6}


def clues(puzzles: DataFrame) -> DataFrame:
    """One ``(word, text)`` row per placed word of ``words: array<struct<word, clue, ..>>``."""
    return each(puzzles, "words", "w").select(
        F.col("w.word").alias("word"), F.col("w.clue").alias("text")
    )


def items(entries: DataFrame, field: str) -> DataFrame:
    """One ``(word, text)`` row per element of an array field; absent arrays give none."""
    return each(entries, field, "text", "word")


def associated(entries: DataFrame) -> DataFrame:
    """Associated terms followed by other terms, duplicates kept."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("associated", none), F.coalesce("other", none))
    return each(entries, both, "text", "word")


def union_bags(bags: dict[str, DataFrame]) -> DataFrame:
    """Union of category bags with a leading ``category`` column (duplicates kept)."""
    return reduce(
        DataFrame.unionByName,
        [bag.select(F.lit(name).alias("category"), "*") for name, bag in bags.items()],
    )


def entry_bags(puzzles: DataFrame, entries: DataFrame) -> DataFrame:
    """The five categories of puzzle and dictionary records in one table."""
    return union_bags(
        {
            "clues": clues(puzzles),
            "definitions": items(entries, "definitions"),
            "examples": items(entries, "examples"),
            "equivalents": items(entries, "equivalents"),
            "associated": associated(entries),
        }
    )


def clean(bag: DataFrame) -> DataFrame:
    """``word``/``text`` -> ``words``/``defs`` token arrays; rows with an empty side go.

    The arrays pass through a generator, so the filter reads them instead of repeating
    the normalisation.
    """
    rest = [c for c in bag.columns if c not in ("word", "text")]
    sides = F.struct(
        T.tokens(T.normalize(F.col("word"))).alias("words"),
        T.tokens(T.normalize(F.col("text"))).alias("defs"),
    )
    return non_empty(each_struct(bag, F.array(sides), "words", *rest))


def non_empty(bag: DataFrame) -> DataFrame:
    return bag.where((F.size("words") > 0) & (F.size("defs") > 0))


def weight_of(category: Column, weights: dict[str, int]) -> Column:
    """Category weight in tenths; an unknown category has weight 0."""
    out = F.lit(0).cast("bigint")
    for name, tenths in weights.items():
        out = F.when(category == name, F.lit(tenths).cast("bigint")).otherwise(out)
    return out


def weigh(bags: DataFrame, weights: dict[str, int] = WEIGHTS_V1) -> DataFrame:
    return bags.withColumn("tenths", weight_of(F.col("category"), weights))
