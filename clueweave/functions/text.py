"""Text normalisation as column expressions (no Python in the hot path)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Replacements applied to upper-cased text, in this order.
ESCAPES = (
    ("’", "'"),
    ("Æ", "AE"),
    ("Œ", "OE"),
    ("'LL", "'WILL"),
    ("CAN'T", "CAN NOT"),
    ("N'T", " NOT"),
    ("'D", " HAD"),
    ("'S", ""),
)

# Stems that are never accepted as a reduction.
REFUSED_STEMS = ("AM", "IS", "AR", "A")


def _accent_table() -> tuple[str, str]:
    """Upper-case Latin letters whose compatibility decomposition has one ASCII letter."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFKD", char) if c.isascii()]
        if char == char.upper() and len(base) == 1 and base[0].isalpha():
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def escape(text: Column) -> Column:
    """Upper-case and expand ligatures and contractions."""
    out = F.upper(F.replace(text, F.lit("ß"), F.lit("ss")))
    for old, new in ESCAPES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


@F.pandas_udf(StringType())
def _decompose(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKD")


def fold(text: Column, full_unicode: bool = False) -> Column:
    """Escape, turn accented letters into plain ones and drop what is not ASCII.

    The default covers the Latin blocks inside the JVM; ``full_unicode`` sends the text
    through an Arrow UDF for the complete compatibility decomposition.
    """
    escaped = escape(text)
    plain = _decompose(escaped) if full_unicode else F.translate(escaped, _ACCENTED, _PLAIN)
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def normalize(text: Column, full_unicode: bool = False) -> Column:
    """Upper-case ASCII words separated by single blanks."""
    return F.trim(F.regexp_replace(fold(text, full_unicode), "[^A-Z0-9]+", " "))


def normalize_web(text: Column) -> Column:
    """Looser form: keeps underscores and leaves runs of blanks as they are."""
    return F.regexp_replace(fold(text), "[^A-Z0-9_]", " ")


def to_ascii(text: Column) -> Column:
    """Escaped text with everything but ASCII letters and digits blanked out."""
    return F.trim(F.regexp_replace(escape(text), "[^A-Z0-9]+", " "))


def tokens(normalized: Column) -> Column:
    """Words of a normalised text; the empty text has none."""
    return F.filter(F.split(normalized, " +"), lambda t: t != "")


def bound(text: Column, begin: str, end: str) -> Column:
    """Text from ``begin`` up to the next ``end``.

    A missing begin marker keeps the start, a missing end marker keeps the rest.
    """
    rest = F.substring(text, F.locate(begin, text), F.lit(2**31 - 1))
    tail = F.when(F.contains(text, F.lit(begin)), rest).otherwise(text)
    return F.substring_index(tail, end, 1)


def safe_name(title: Column) -> Column:
    """Title reduced to characters that are safe in a file name."""
    return F.trim(F.regexp_replace(title, "[^A-Za-z0-9 ]", ""))


def sanitize_clue(clue: Column) -> Column:
    return F.regexp_replace(clue, "[^A-Za-z0-9 ]", " ")


def puzzle_word(word: Column) -> Column:
    """Answer as it is written into the grid: upper-case letters only."""
    return F.regexp_replace(F.upper(word), "[^A-Z]", "")


def category_from_title(title: Column) -> Column:
    """``cryptic`` when the first title word says so, otherwise null."""
    first = F.lower(F.substring_index(title, " ", 1))
    return F.when(first.isin("cryptic", "quiptic"), F.lit("cryptic"))


def category_from_part(part: Column) -> Column:
    """Category named by a url part; the two dated series map to their plain names."""
    return (
        F.when(part == "2s_straight", F.lit("straight"))
        .when(part == "2s_cryptic", F.lit("cryptic"))
        .otherwise(part)
    )


def clue_date(text: Column) -> Column:
    """``Wednesday 6 May 2015 00.01 BST`` -> ISO day in GMT; unreadable -> null."""
    unnamed = F.regexp_replace(F.trim(text), "^[A-Za-z]+ +", "")
    moment = F.try_to_timestamp(unnamed, F.lit("d MMMM y HH.mm z"))
    # the session's time zone must not decide the day
    gmt = F.to_utc_timestamp(moment, F.current_timezone())
    return F.date_format(gmt, "yyyy-MM-dd")


def compact_date(text: Column) -> Column:
    """``20150506`` -> ``2015-05-06``; unreadable -> null."""
    return F.date_format(F.try_to_timestamp(text, F.lit("yyyyMMdd")), "yyyy-MM-dd")


def visible(html: Column) -> Column:
    """Text that a page shows: scripts, styles, comments, tags and references become blanks."""
    markup = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
    return F.regexp_replace(F.regexp_replace(html, markup, " "), "&#?[A-Za-z0-9]+;", " ")
