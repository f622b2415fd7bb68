"""Word, puzzle and dictionary shaped views over the driver tables.

Everything is derived row by row from whole tables and whole texts.  Bag entries are
tumbling windows of eight tokens, so entry size is fixed while entry count follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clueweave.functions import text as T
from clueweave.operators import bags as B
from clueweave.operators import graph as G
from clueweave.operators import stems as S
from clueweave.operators.unnest import each, each_struct
from clueweave.session import spread, written

HEAD, ENTRY = 2, 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_text(spark: SparkSession, folder: str) -> DataFrame:
    """``(category, src_id, text)``: documents by language, benchmark items as associated."""
    lang = F.col("lang")
    category = (
        F.when(lang == "en", "clues")
        .when(lang == "fr", "definitions")
        .when(lang == "de", "examples")
        .otherwise("equivalents")
    )
    docs = spread(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    bench = table(spark, folder, "benchmark")
    return docs.select(category.alias("category"), F.col("doc_id").alias("src_id"), "text").union(
        bench.select(F.lit("associated"), "item_id", "text")
    )


def chat_text(spark: SparkSession, folder: str) -> DataFrame:
    """``(category, src_id, text)``: conversation turns by role and turn, benchmark items."""
    role = F.col("role")
    category = (
        F.when(role == "user", "clues")
        .when((role == "assistant") & (F.col("turn") % 4 == 1), "definitions")
        .when(role == "assistant", "associated")
        .otherwise("examples")
    )
    turns = spread(table(spark, folder, "conversations")).select(
        category.alias("category"), F.concat_ws(":", "conv_id", "turn").alias("src_id"), "text"
    )
    bench = table(spark, folder, "benchmark").select(F.lit("equivalents"), F.col("item_id").cast("string"), "text")
    return turns.union(bench)


def chat_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """``(category, src_id, text)``: conversation turns by role, benchmark items, and the whole
    visible text of every page as associated."""
    role = F.col("role")
    category = (
        F.when(role == "user", "clues").when(role == "assistant", "definitions").otherwise("examples")
    )
    turns = spread(table(spark, folder, "conversations")).select(
        category.alias("category"), F.concat_ws(":", "conv_id", "turn").alias("src_id"), "text"
    )
    bench = table(spark, folder, "benchmark").select(F.lit("equivalents"), F.col("item_id").cast("string"), "text")
    pages = page_text(spark, folder).select(F.lit("associated"), F.col("src_id").cast("string"), "text")
    return turns.union(bench).union(pages)


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    """``(category, src_id, text)``: the whole visible text of every page, by its language."""
    lang = F.regexp_extract("html", '<html lang="([^"]*)"', 1)
    category = (
        F.when(lang == "en", "clues")
        .when(lang == "fr", "definitions")
        .when(lang == "de", "examples")
        .otherwise("equivalents")
    )
    return spread(table(spark, folder, "pages")).select(
        category.alias("category"), F.col("page_id").alias("src_id"), T.visible(F.col("html")).alias("text")
    )


def token_rows(source: DataFrame) -> DataFrame:
    """``(category, src_id, toks)``; an empty text has an empty list.

    No filter here: Spark would move it below the repartitioning of small inputs and
    normalise every text twice.  Exploding drops the empty lists anyway.
    """
    return source.select("category", "src_id", T.tokens(T.normalize(F.col("text"))).alias("toks"))


def _entries(toks: Column) -> Column:
    count = F.floor((F.size(toks) + ENTRY - 1) / ENTRY)
    return F.transform(
        F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)),
        lambda w: F.struct(
            w.alias("win"),
            F.slice(toks, (w * ENTRY + 1).cast("int"), F.lit(HEAD)).alias("words"),
            F.slice(toks, (w * ENTRY + 1 + HEAD).cast("int"), F.lit(ENTRY - HEAD)).alias("defs"),
        ),
    )


def clean_bags(source: DataFrame) -> DataFrame:
    """``(category, src_id, win, words, defs)`` with both sides present."""
    return bags_of(token_rows(source))


def bags_of(tokens: DataFrame) -> DataFrame:
    return B.non_empty(each_struct(tokens, _entries(F.col("toks")), "win", "category", "src_id"))


def edges_v1(source: DataFrame) -> DataFrame:
    return G.word_def_edges(B.weigh(clean_bags(source)))


def totals_v1(source: DataFrame) -> DataFrame:
    """Summed pairs of :func:`edges_v1` with the largest sum of their source."""
    return G.word_def_totals(B.weigh(clean_bags(source)))


def graph_v1(source: DataFrame, keep_weak: bool = False) -> DataFrame:
    """Combined, normalised graph ``(src, dst, micro)``."""
    return G.normalise(totals_v1(source), keep_weak)


def vocabulary(source: DataFrame) -> DataFrame:
    return each(token_rows(source), "toks", "form").distinct()


def stems(source: DataFrame) -> DataFrame:
    return S.derive_stems(vocabulary(source))


def stemmed_bags(source: DataFrame, keep: str = "true") -> DataFrame:
    """Clean bags (those for which ``keep`` holds) with ``words_stem`` and ``defs_stem``.

    The token table feeds both the vocabulary and the bags, so it is written once; the stemmed
    bags are read once and are not.
    """
    tokens = written(token_rows(source), "tokens")
    forms = each(tokens, "toks", "form").distinct()
    keys = ["category", "src_id", "win"]
    return S.stem_arrays(bags_of(tokens).where(keep), keys, ["words", "defs"], S.derive_stems(forms))


def placed_words(spark: SparkSession, folder: str) -> DataFrame:
    """``(cwid, wid, x, y, word, clue, dir)``: line items as words placed in puzzles."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("wid"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("word"),
        F.col("p_type").alias("clue"),
    )
    return (
        lines.select(
            F.col("l_orderkey").alias("cwid"),
            F.col("l_partkey").alias("wid"),
            F.col("l_linenumber").alias("x"),
            (F.col("l_suppkey") % 7).cast("int").alias("y"),
            F.when(F.col("l_partkey") % 2 == 0, "East").otherwise("South").alias("dir"),
        )
        .join(parts, "wid")
        .select("cwid", "wid", "x", "y", "word", "clue", "dir")
    )
