"""Weighted word graph.

Weights are integers throughout (tenths for categories, millionths after normalising), so
sums and maxima do not depend on the order in which Spark meets the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueweave.operators.bags import WEIGHTS_V2, weight_of
from clueweave.operators.skew import salted_join
from clueweave.operators.sums import cross_extremes, cross_totals, pair_totals
from clueweave.operators.unnest import each_struct

MICRO = 1_000_000


def word_def_edges(bags: DataFrame) -> DataFrame:
    """Every (word, definition token) pair of a row with the row's weight; weight 0 drops."""
    return (
        bags.where("tenths <> 0")
        .select(F.explode("words").alias("src"), "defs", "tenths")
        .select("src", F.explode("defs").alias("dst"), "tenths")
    )


def word_def_totals(bags: DataFrame) -> DataFrame:
    """``combine_totals(word_def_edges(bags))``; the pairs of a row are made where they are summed up."""
    lists = [F.col("words").alias("srcs"), F.col("defs").alias("dsts"), F.col("tenths").alias("w")]
    return cross_totals(bags.where("tenths <> 0").select(*lists))


def norm_stem_edges(bags: DataFrame, weights: dict[str, int] = WEIGHTS_V2) -> DataFrame:
    """Surface form <-> stem at the same place, both ways, at the equivalents weight."""
    pairs = F.concat(
        F.arrays_zip(F.col("words").alias("a"), F.col("words_stem").alias("b")),
        F.arrays_zip(F.col("defs").alias("a"), F.col("defs_stem").alias("b")),
    )
    both = F.flatten(
        F.transform(
            F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull()),
            lambda p: F.array(
                F.struct(p["a"].alias("src"), p["b"].alias("dst")),
                F.struct(p["b"].alias("src"), p["a"].alias("dst")),
            ),
        )
    )
    return each_struct(bags, both, "src").withColumn(
        "tenths", F.lit(weights["equivalents"]).cast("bigint")
    )


def _cross(left, right, tenths):
    """Array of edges between every element of two arrays of one row."""
    return F.flatten(
        F.transform(
            left,
            lambda a: F.transform(
                right,
                lambda b: F.struct(a.alias("src"), b.alias("dst"), tenths.alias("tenths")),
            ),
        )
    )


def expression_edges(bags: DataFrame, weights: dict[str, int] = WEIGHTS_V2) -> DataFrame:
    """Edge families of the second graph version other than surface form <-> stem.

    Repeated tokens inside a row are dropped first: the later maximum per pair makes
    them redundant.  All families come from one pass over the rows.
    """
    asso = F.lit(weights["associated"]).cast("bigint")
    weak = F.lit(weights["examples"]).cast("bigint")
    words, defs = F.array_distinct("words_stem"), F.array_distinct("defs_stem")
    expr = F.array(F.array_join("words", " "))
    families = F.concat(
        _cross(words, words, asso),
        _cross(defs, defs, weak),
        _cross(words, expr, asso),
        _cross(expr, words, asso),
        _cross(defs, expr, weak),
        _cross(expr, defs, weight_of(F.col("category"), weights)),
    )
    return each_struct(bags, families, "src")


def all_edges_v2(bags: DataFrame, weights: dict[str, int] = WEIGHTS_V2) -> DataFrame:
    return norm_stem_edges(bags, weights).unionByName(expression_edges(bags, weights))


def extremes_v2(bags: DataFrame, weights: dict[str, int] = WEIGHTS_V2) -> DataFrame:
    """``(src, dst, strongest, weakest)``: the pairs of ``all_edges_v2(bags)`` with their largest and
    smallest weight; the pairs of a row are made where they are compared."""
    asso, weak, same = (F.lit(weights[n]).cast("bigint") for n in ("associated", "examples", "equivalents"))

    def crossed(left, right, tenths):
        return F.struct(left.alias("srcs"), right.alias("dsts"), tenths.alias("w"))

    def both(p):
        there, back = crossed(F.array(p["a"]), F.array(p["b"]), same), crossed(F.array(p["b"]), F.array(p["a"]), same)
        return F.when(p["a"] == p["b"], F.array(there)).otherwise(F.array(there, back))

    pairs = F.concat(
        F.arrays_zip(F.col("words").alias("a"), F.col("words_stem").alias("b")),
        F.arrays_zip(F.col("defs").alias("a"), F.col("defs_stem").alias("b")),
    )
    known = F.array_distinct(F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull()))
    words, defs = F.array_distinct("words_stem"), F.array_distinct("defs_stem")
    expr = F.array(F.array_join("words", " "))
    families = F.array(
        crossed(words, F.concat(words, expr), asso),
        crossed(expr, words, asso),
        crossed(defs, F.concat(defs, expr), weak),
        crossed(expr, defs, weight_of(F.col("category"), weights)),
    )
    none = F.array().cast("array<struct<srcs: array<string>, dsts: array<string>, w: bigint>>")
    families = F.when(words.isNotNull() & defs.isNotNull(), families).otherwise(none)
    rows = each_struct(bags, F.concat(F.coalesce(F.flatten(F.transform(known, both)), none), families), "srcs")
    return cross_extremes(rows).where("src IS NOT NULL")


def combine_max_v2(bags: DataFrame, weights: dict[str, int] = WEIGHTS_V2) -> DataFrame:
    """``combine_max(all_edges_v2(bags))`` by :func:`extremes_v2`."""
    found = extremes_v2(bags, weights).where("src <> dst")
    return found.select("src", "dst", F.col("strongest").alias("tenths"))


def combine_totals(edges: DataFrame) -> DataFrame:
    """``(src, dst, w, m)``: sum per pair and the largest sum of its source."""
    return pair_totals(edges.select("src", "dst", F.col("tenths").cast("bigint").alias("w")))


def combine_sum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("tenths").alias("w"))


def combine_norm(edges: DataFrame, keep_weak: bool = False) -> DataFrame:
    """Sum per pair over the largest sum of the source, in millionths; below 0.1 drops."""
    return normalise(combine_totals(edges), keep_weak)


def normalise(summed: DataFrame, keep_weak: bool = False) -> DataFrame:
    """Second half of :func:`combine_norm`, for pairs with their sum and their source's largest sum."""
    kept = summed.where("src IS NOT NULL")
    if not keep_weak:
        kept = kept.where("10 * w >= m")
    return kept.select("src", "dst", F.expr(f"({MICRO} * w) div m").alias("micro"))


def combine_max(edges: DataFrame) -> DataFrame:
    """Largest weight per pair without self loops."""
    return edges.where("src <> dst").groupBy("src", "dst").agg(F.max("tenths").alias("tenths"))


def two_hop(edges: DataFrame, weight: str, unit: int, least: float = 0.1) -> DataFrame:
    """Edges plus paths of length two (product of weights), largest per pair, ``>= least``.

    Weights count ``1/unit``; results count ``1/unit**2``.  Two edges below the square root
    of the threshold can never pass together, so weak edges only look for strong ones: the
    join key is (middle node, strength of the second edge).  Busy middle nodes are salted.
    """
    floor = round(least * unit * unit)
    strong = F.col(weight).cast("bigint") * F.col(weight) >= floor
    first = edges.select(
        F.col("dst").alias("mid"),
        "src",
        F.col(weight).alias("w1"),
        F.explode(F.when(strong, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
        .alias("strong"),
    )
    second = edges.select(
        F.col("src").alias("mid"), "dst", F.col(weight).alias("w2"), strong.alias("strong")
    )
    paths = (
        salted_join(first, second, ["mid", "strong"], "mid", F.col("src"))
        .where(F.col("w1") * F.col("w2") >= floor)
        .select("src", "dst", (F.col("w1") * F.col("w2")).alias("w"))
    )
    direct = edges.select("src", "dst", (F.col(weight) * unit).alias("w")).where(F.col("w") >= floor)
    return paths.unionByName(direct).groupBy("src", "dst").agg(F.max("w").alias("w"))
