"""Wildcard patterns (``*`` any run, ``?`` one character) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(pattern: Column) -> Column:
    """Upper-case pattern with only letters and the two wildcards left."""
    return F.regexp_replace(F.upper(pattern), r"[^A-Z*?]", "")


def to_regex(pattern: Column) -> Column:
    return F.replace(
        F.replace(tidy(pattern), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")
    )


def to_like(pattern: Column) -> Column:
    return F.replace(F.replace(tidy(pattern), F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))


def matches(word: Column, pattern: Column, is_tidy: bool = False) -> Column:
    """Whole-word match of a pattern that may differ from row to row.

    Letters with a single ``*`` need no regex: the word starts and ends as the pattern.
    """
    tidied = pattern if is_tidy else tidy(pattern)
    head, tail = F.substring_index(tidied, "*", 1), F.substring_index(tidied, "*", -1)
    one_star = F.length(head) + F.length(tail) == F.length(tidied) - 1
    ends = (
        F.startswith(word, head)
        & F.endswith(word, tail)
        & (F.length(word) >= F.length(tidied) - 1)
    )
    dotted = F.replace(F.replace(tidied, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    regex = F.rlike(word, F.concat(F.lit("^"), dotted, F.lit("$")))
    return F.when(one_star & ~F.contains(tidied, F.lit("?")), ends).otherwise(regex)


def tidy_literal(pattern: str) -> str:
    return "".join(c for c in pattern.upper() if c in "*?" or "A" <= c <= "Z")


def like_literal(pattern: str) -> str:
    """LIKE form of one known pattern; a leading literal run reaches the Parquet scan."""
    return tidy_literal(pattern).replace("*", "%").replace("?", "_")


def regex_literal(pattern: str) -> str:
    return tidy_literal(pattern).replace("*", ".*").replace("?", ".")
