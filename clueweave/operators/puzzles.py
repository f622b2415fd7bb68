"""Relational puzzle store: items, clues, random picks and typed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: text given for a word without any clue.
NO_CLUE = "No clue found"

# What a typed read gives instead of SQL null.
TYPE_DEFAULTS = {"string": "", "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "decimal": 0}


def puzzle_items(items: DataFrame, words: DataFrame) -> DataFrame:
    """Items of all puzzles with their word text."""
    return items.join(words, "wid")


def clues_of(items: DataFrame, word: str) -> DataFrame:
    """All clues given for one word."""
    return items.where(F.col("word") == word).select("word", "clue")


def clue_for_each(words: DataFrame, items: DataFrame) -> DataFrame:
    """One clue per word, the default text when there is none."""
    first = items.groupBy("word").agg(F.min("clue").alias("clue"))
    return words.join(first, "word", "left").withColumn("clue", F.coalesce("clue", F.lit(NO_CLUE)))


def shuffled(rows: DataFrame, key: str, n: int, seed: str | None = None) -> DataFrame:
    """``n`` random rows; with a seed the order is that of ``md5(seed || key)``."""
    if seed is None:
        return rows.orderBy(F.rand()).limit(n)
    place = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return rows.orderBy(place, key).limit(n)


def letter_words(words: DataFrame) -> DataFrame:
    """Words made of letters only."""
    return words.where(F.rlike("word", F.lit("^[a-zA-Z]+$")))


def item_json(items: DataFrame) -> DataFrame:
    """Each item as the JSON object of a puzzle record's ``words`` list."""
    return items.withColumn("item", F.to_json(F.struct("word", "clue", "x", "y", "dir")))


def puzzle_records(items: DataFrame) -> DataFrame:
    """``(cwid, words)`` with the nested list of a puzzle record.

    Duplicates of the key (puzzle, place, direction) are merged first, so a list is never
    longer than two entries per grid cell.
    """
    unique = items.groupBy("cwid", "x", "y", "dir").agg(
        F.min(F.struct("word", "clue")).alias("entry")
    )
    entry = F.struct("entry.word", "entry.clue", "x", "y", "dir")
    return unique.groupBy("cwid").agg(F.sort_array(F.collect_list(entry)).alias("words"))


def typed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Trimmed, cast columns with the type's default in place of null or unreadable text."""
    out = []
    for name, kind in columns.items():
        default = TYPE_DEFAULTS[kind.split("(")[0]]
        value = F.trim(F.col(f"`{name}`").cast("string"))
        value = value if kind == "string" else value.try_cast(kind)
        out.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    return rows.select(*out)


def normalise(puzzles: DataFrame, dictionary: DataFrame) -> dict[str, DataFrame]:
    """Nested puzzle records -> the four tables puzzles, words, items and categories."""
    placed = puzzles.select("cwid", F.explode("words").alias("w")).select(
        "cwid", "w.word", "w.clue", "w.x", "w.y", "w.dir"
    )
    return {
        "puzzles": puzzles.drop("words", "categories"),
        "words": dictionary,
        "items": placed.join(dictionary, "word").drop("word"),
        "categories": puzzles.select("cwid", F.explode("categories").alias("category")).distinct(),
    }
