"""A training corpus from raw documents: quality, lines, near copies, leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; ``run`` writes each stage as
Parquet in the shared folder and hands the reread table to the next, so a lost executor repeats a
part of one stage only.

1. ``quality``: the classifier is fitted on the labelled rows among its input; documents that it
   predicts to be bad go.
2. ``lines``: boilerplate lines on many sources stay only where they stand first.
3. ``near_copies``: one document of each SimHash component stays.
4. ``leaks``: documents that hold a benchmark item go.
5. ``packing``: the rest as power-of-two pieces.

Defined cases are those of the operators: null texts count as empty, repeated rows are judged one
by one (equal rows are near copies, so one stays), further columns are kept, an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueweave.llm import decontaminate, line_dedup, quality, queries, simhash_dedup
from clueweave.llm.common import table
from clueweave.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= quality.THRESHOLD)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate; ``n_chars`` follows the text."""
    cleaned = line_dedup.drop_boilerplate(docs, queries.MIN_SITES)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(*(f"`{c}`" for c in docs.columns))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    kept = simhash_dedup.keep_one(docs, size=queries.SHINGLE_WORDS, radius=queries.RADIUS)
    return kept.select(*(f"`{c}`" for c in docs.columns))


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with the digests of their ids."""
    return queries.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_copies", near_copies_stage),
    ("leaks", leaks_stage),
    ("packing", packing_stage),
]

#: Compressed sizes, XXH64 fingerprints and token ids have no SQL form; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
