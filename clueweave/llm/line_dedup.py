"""Removal of boilerplate lines by the number of distinct sites that show them.

Only DataFrame functions are used.  A line is a part of the text between newlines, compared after
trimming blanks; empty lines are never touched.  Lines on ``min_sites`` or more distinct sites are
boilerplate: they stay where they stand first (smallest document id, nulls last; then first in its
text) and go from everywhere else, the newlines around them included.

1. Lines are counted by hash.  A line with fewer rows than ``min_sites`` cannot be on so many
   sites, so only the frequent ones go on; this bound is exact.
2. HyperLogLog sketches of the sites are built per frequent line and merged by the aggregation, so
   a line on millions of pages needs a few kilobytes.  Estimates beyond ``margin`` of the threshold
   decide at once.
3. Lines whose estimate is near the threshold get an exact distinct count.
4. The lines to drop are gathered per document and taken out of the text.

Defined cases: a null text stays null, an empty one empty; null sites count as no site; rows equal
in id and text are one document, so all of them keep a first line.  All columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueweave.llm.common import two_hashes
from clueweave.session import written

#: Sketches of 2**12 registers: a standard error of 1.6 %, so 10 % is more than six of them.
SKETCH_BITS = 12
MARGIN = 0.1


def _occurrences(docs: DataFrame, site: str) -> DataFrame:
    """One row per line that is not blank: document key, order of the document, place and hashes."""
    d1, d2 = two_hashes(F.col("doc_id"), F.col("text"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d1", "d2")
    rows = docs.select("doc_id", "text", F.col(site).alias("site"))
    rows = rows.withColumn("d1", d1).withColumn("d2", d2)
    lines = rows.select(
        "d1", "d2", "site", order.alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).withColumn("line", F.trim("line"))
    h1, h2 = two_hashes(F.col("line"))
    return lines.where("line <> ''").select(
        "d1", "d2", "site", "doc", "pos", h1.alias("h1"), h2.alias("h2")
    )


def boilerplate(
    docs: DataFrame, min_sites: int, site: str = "source", margin: float = MARGIN
) -> DataFrame:
    """``(h1, h2, first)`` of the lines on ``min_sites`` sites or more; ``first`` is where one stays."""
    rows = _occurrences(docs, site)
    frequent = written(
        rows.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites),
        "frequent-lines",
    ).select("h1", "h2")
    sketched = written(
        rows.join(frequent, ["h1", "h2"])
        .groupBy("h1", "h2")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"),
            F.min(F.struct("doc", "pos")).alias("first"),
        ),
        "sketched-lines",
    )
    low, high = min_sites / (1 + margin), min_sites * (1 + margin)
    near = sketched.where(F.col("sites").between(low, high))
    exact = (
        rows.join(near.select("h1", "h2", "first"), ["h1", "h2"])
        .groupBy("h1", "h2", "site")
        .agg(F.first("first").alias("first"))
        .groupBy("h1", "h2")
        .agg(F.count("site").alias("sites"), F.first("first").alias("first"))
    )
    sure = sketched.where(F.col("sites") > high).select("h1", "h2", "first")
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2", "first"))


def drop_boilerplate(
    docs: DataFrame, min_sites: int, site: str = "source", margin: float = MARGIN
) -> DataFrame:
    """``docs`` with cleaned ``text`` and two more columns, ``n_lines`` and ``n_removed``."""
    spread = written(boilerplate(docs, min_sites, site, margin), "boilerplate")
    rows = _occurrences(docs, site)
    again = rows.join(spread, ["h1", "h2"]).where(
        F.struct("doc", "pos") != F.col("first")
    )
    bad = again.groupBy("d1", "d2").agg(F.collect_set("pos").alias("__bad"))
    bad = bad.select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "__bad")
    d1, d2 = two_hashes(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumn("__d1", d1).withColumn("__d2", d2)
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains("__bad", i))
    cleaned = F.when(F.col("__bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return (
        keyed.join(bad, ["__d1", "__d2"], "left")
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("bigint"))
        .withColumn("n_removed", F.coalesce(F.size("__bad"), F.lit(0)).cast("bigint"))
        .withColumn("text", cleaned)
        .drop("__d1", "__d2", "__bad")
    )


#: The same over ``documents`` in plain SQL; ``{min_sites}`` is filled in.
SQL = """
WITH numbered AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), places AS (
  SELECT doc_id, source, lines, unnest(range(len(lines))) AS pos FROM numbered
), occ AS (
  SELECT doc_id, source, pos, trim(lines[pos + 1], ' ') AS line FROM places
), spread AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first
  FROM occ WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {min_sites}
), bad AS (
  SELECT doc_id, list(pos) AS bad
  FROM occ JOIN spread USING (line)
  WHERE struct_pack(d := doc_id, p := pos) <> first GROUP BY doc_id
)
SELECT doc_id,
  CASE WHEN bad IS NULL THEN text ELSE array_to_string(
    list_filter(lines, lambda l, i: NOT list_contains(bad, i - 1)), chr(10)) END AS text,
  coalesce(len(lines), 0) AS n_lines, coalesce(len(bad), 0) AS n_removed
FROM numbered LEFT JOIN bad USING (doc_id)
"""
