"""Dense word ids and the joins that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clueweave.session import written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def vocabulary(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct words found at either end of an edge."""
    return edges.select(F.col(src).alias("word")).union(edges.select(dst)).distinct()


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with dense 0-based numbers ``name`` in the order of the columns ``by``.

    The rows are range-partitioned and sorted once; a row's number is its place inside its range
    plus the size of the ranges before it.  Only one count per range takes part in the running sum,
    so no task ever sees all rows.  The sorted ranges are written first because a re-run of the
    range sampling could draw other borders.
    """
    ranges = unique_ids(rows.repartitionByRange(*by).sortWithinPartitions(*by), "slot")
    placed = written(ranges, "numbered").withColumn("range", F.shiftright("slot", _ROW_BITS))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: bounded by the number of shuffle partitions
    offsets = (
        placed.groupBy("range")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    number = F.col("offset") + F.col("slot").bitwiseAND((1 << _ROW_BITS) - 1)
    return placed.join(F.broadcast(offsets), "range").withColumn(name, number).drop("range", "slot", "offset")


def build(words: DataFrame, column: str = "word") -> DataFrame:
    """``(wid, word)``: dense 0-based ids of the distinct words in alphabetical order."""
    distinct = words.select(F.col(column).alias("word")).where(F.col("word").isNotNull()).distinct()
    return numbered(distinct, ["word"], "wid").select("wid", "word")


def get_id(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ids of the given words; unknown words drop out, duplicates stay."""
    return words.join(dictionary, "word")


def get_word(ids: DataFrame, dictionary: DataFrame) -> DataFrame:
    return ids.join(dictionary, "wid")


def to_index(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Replace ``src``/``dst`` by ``wid_from``/``wid_to`` (two dictionaries allowed).

    Call it after combining: there are fewer pairs then, and each pair occurs once.
    """
    targets = sources if targets is None else targets
    return (
        edges.join(sources.select(F.col("wid").alias("wid_from"), F.col("word").alias("src")), "src")
        .join(targets.select(F.col("wid").alias("wid_to"), F.col("word").alias("dst")), "dst")
        .drop("src", "dst")
    )


def edge_words(adjacency: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Both words of every indexed edge."""
    return (
        adjacency.join(
            dictionary.select(F.col("wid").alias("wid_from"), F.col("word").alias("src")), "wid_from"
        )
        .join(dictionary.select(F.col("wid").alias("wid_to"), F.col("word").alias("dst")), "wid_to")
    )


def unique_ids(rows: DataFrame, name: str = "id") -> DataFrame:
    """Unique ids without a shuffle; they are neither dense nor stable between runs."""
    return rows.withColumn(name, F.monotonically_increasing_id())


def max_id(rows: DataFrame, field: str) -> DataFrame:
    """Largest id in use, -1 for an empty table."""
    return rows.agg(F.coalesce(F.max(field), F.lit(-1)).cast("bigint").alias("max_id"))
