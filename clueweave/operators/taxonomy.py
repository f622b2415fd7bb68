"""Taxonomy jobs over an edge table ``(child, parent, rel)`` and a sense table.

The sense table is ``(lemma, kind, sense, node)``.  Word similarity follows the published
definitions (path, Wu-Palmer, Leacock-Chodorow, Resnik, Lin, Jiang-Conrath).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueweave.operators.skew import salted_join
from clueweave.session import written

# Relations and the relation read from the other end.
INVERSE = {
    "hypernym": "hyponym",
    "part_holonym": "part_meronym",
    "substance_holonym": "substance_meronym",
    "member_holonym": "member_meronym",
    "entailment": "entailed_by",
    "antonym": "antonym",
}


def related(edges: DataFrame) -> DataFrame:
    """``(node, rel, other)`` in both directions."""
    inverse = F.lit(None).cast("string")
    for name, back in INVERSE.items():
        inverse = F.when(F.col("rel") == name, back).otherwise(inverse)
    there = edges.select(F.col("child").alias("node"), "rel", F.col("parent").alias("other"))
    back = edges.select(F.col("parent").alias("node"), inverse.alias("rel"), F.col("child").alias("other"))
    return there.unionByName(back.where("rel IS NOT NULL")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """``(node, anc, dist)``: all proper ancestors with every path length.

    Paths double: after a round all lengths up to ``2 * reach`` are known, because a longer path is
    one of exactly ``reach`` edges followed by a known one, and distances add.  The rounds, each
    written, are as many as the depth has binary digits.  Only ancestors that are reached in exactly
    ``reach`` edges are looked up again, and busy ones are salted.  A node that reaches itself is an
    error.
    """
    pairs = edges.select(F.col("child").alias("node"), F.col("parent").alias("anc")).distinct()
    newest = written(pairs.withColumn("dist", F.lit(1)), "closure")
    known, reach = newest, 1
    while True:
        if not newest.where("node = anc").isEmpty():
            raise ValueError("the hierarchy has a cycle")
        ends = newest.where(F.col("dist") == reach).withColumnRenamed("anc", "key")
        onward = known.select(F.col("node").alias("key"), F.col("anc"), F.col("dist").alias("more"))
        onward = onward.join(ends.select("key").distinct(), "key", "left_semi")
        longer = salted_join(ends, onward, ["key"], "key", F.col("node"), counted=ends)
        longer = longer.select("node", "anc", (F.col("dist") + F.col("more")).alias("dist")).distinct()
        newest = written(longer, "closure")
        if newest.isEmpty():
            return known
        known, reach = known.unionByName(newest), 2 * reach


def with_self(paths: DataFrame) -> DataFrame:
    """Nearest distance to every ancestor, the node itself included at distance 0."""
    ends = paths.select("node").union(paths.select("anc")).distinct()
    near = paths.groupBy("node", "anc").agg(F.min("dist").alias("dist"))
    return near.unionByName(ends.select("node", F.col("node").alias("anc"), F.lit(0).alias("dist")))


def roots(paths: DataFrame) -> DataFrame:
    """``(node, root)``: the top ancestors of every node (a root is its own)."""
    return _root_paths(paths).select("node", "root").distinct()


def _root_paths(paths: DataFrame) -> DataFrame:
    tops = paths.select("anc").distinct().join(paths.select(F.col("node").alias("anc")).distinct(), "anc", "left_anti")
    below = salted_join(paths, tops, ["anc"], "anc", F.col("node")).select("node", F.col("anc").alias("root"), "dist")
    return below.unionByName(tops.select(F.col("anc").alias("node"), F.col("anc").alias("root"), F.lit(0).alias("dist")))


def depth(paths: DataFrame) -> DataFrame:
    """Shortest and longest path length from every node to a root."""
    return _root_paths(paths).groupBy("node").agg(
        F.min("dist").alias("depth_min"), F.max("dist").alias("depth_max")
    )


def _placed(up: DataFrame, values: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node, above, of)`` and the lists ``(above, list)`` that they share.

    ``up`` is the result of :func:`with_self`.  Nodes with the same proper ancestors share one list of
    ``(anc, dist, of)``, so a pair carries the number of a list through the shuffles and not the list.
    ``of`` is the value of a node or an ancestor in ``values`` ``(node, value)``, null without one.
    """
    proper = F.collect_list(F.when(F.col("anc") != F.col("node"), F.struct("anc", "dist")))
    nodes = written(up.groupBy("node").agg(F.sort_array(proper).alias("list")), "nodes")
    lists = written(nodes.select("list").distinct().withColumn("above", F.monotonically_increasing_id()), "lists")
    nodes = nodes.join(lists, "list").select("node", "above")
    entries = lists.select("above", F.explode_outer("list").alias("e")).select("above", "e.anc", "e.dist")
    if values is None:
        nodes, entries = (rows.withColumn("of", F.lit(None).cast("double")) for rows in (nodes, entries))
    else:
        nodes = nodes.join(values.select("node", F.col("value").alias("of")), "node", "left")
        entries = entries.join(values.select(F.col("node").alias("anc"), F.col("value").alias("of")), "anc", "left")
    held = F.collect_list(F.when(F.col("anc").isNotNull(), F.struct("anc", "dist", "of")))
    return nodes, written(entries.groupBy("above").agg(held.alias("list")), "above")


def _nearest(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Add ``best`` ``(total, lca, da, db, of)`` to rows ``a, above_a, of_a, b, above_b, of_b``."""

    def side(x):
        return lists.select(F.col("above").alias(f"above_{x}"), F.col("list").alias(f"list_{x}"))

    both = rows.join(side("a"), "above_a", "left").join(side("b"), "above_b", "left")
    one = lambda lca, da, db, of: F.struct(
        (da + db).alias("total"), lca.alias("lca"), da.alias("da"), db.alias("db"), of.alias("of")
    )
    a, b, none = F.col("a"), F.col("b"), F.lit(0)
    shared = F.flatten(
        F.transform(
            "list_a",
            lambda x: F.transform(
                F.filter("list_b", lambda y: y["anc"] == x["anc"]), lambda y: one(x["anc"], x["dist"], y["dist"], x["of"])
            ),
        )
    )
    over = F.transform(F.filter("list_b", lambda y: y["anc"] == a), lambda y: one(a, none, y["dist"], F.col("of_a")))
    under = F.transform(F.filter("list_a", lambda x: x["anc"] == b), lambda x: one(b, x["dist"], none, F.col("of_b")))
    same = F.when((a == b) & F.col("list_a").isNotNull(), F.array(one(a, none, none, F.col("of_a"))))
    found = F.concat(*[F.coalesce(part, F.array().cast("array<void>")) for part in (shared, over, under, same)])
    return both.withColumn("best", F.array_min(found))


def common_ancestor(rows: DataFrame, up: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Add ``lca, da, db`` for columns ``a, b``: the common ancestor nearest to both, then by id.

    ``up`` is the result of :func:`with_self`.  The search happens inside the row of a pair, over the
    lists of :func:`_placed` (their length is bounded by the hierarchy above a node).  Without a common
    ancestor the three are null.  With ``values`` ``(node, value)``, each node once, the look-ups of
    ``a`` and ``b`` bring the values along: ``of_a, of_b, of_lca``, null for a node without one.
    """
    nodes, lists = _placed(up, values)

    def at(x):
        return nodes.select(F.col("node").alias(x), F.col("above").alias(f"above_{x}"), F.col("of").alias(f"of_{x}"))

    both = salted_join(rows, at("a"), ["a"], "a", F.col("b"), how="left")
    both = salted_join(both, at("b"), ["b"], "b", F.col("a"), how="left", counted=rows)
    found = _nearest(both, lists)
    brought = [] if values is None else ["of_a", "of_b", F.col("best.of").alias("of_lca")]
    return found.select(*rows.columns, "best.lca", "best.da", "best.db", *brought)


def senses_with_gloss(senses: DataFrame, glosses: DataFrame) -> DataFrame:
    """Senses with definition and quoted examples taken from ``;``-separated glosses."""
    parts = F.transform(F.split("gloss", ";"), lambda part: F.trim(part))
    quoted = F.filter(parts, lambda p: F.startswith(p, F.lit('"')))
    plain = F.filter(parts, lambda p: ~F.startswith(p, F.lit('"')))
    return senses.join(glosses, "node").select(
        "lemma",
        "kind",
        "sense",
        "node",
        F.array_join(plain, "; ").alias("definition"),
        F.transform(quoted, lambda q: F.regexp_replace(q, '"', "")).alias("examples"),
    )


def kinds(senses: DataFrame) -> DataFrame:
    """Kinds of every lemma as a sorted array (there are only a handful of kinds)."""
    return senses.groupBy("lemma").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def common_kind(pairs: DataFrame, senses: DataFrame) -> DataFrame:
    """Alphabetically first kind shared by two lemmas, null when there is none."""
    by_lemma = kinds(senses)
    left = by_lemma.select(F.col("lemma").alias("lemma_a"), F.col("kinds").alias("ka"))
    right = by_lemma.select(F.col("lemma").alias("lemma_b"), F.col("kinds").alias("kb"))
    joined = pairs.join(left, "lemma_a", "left").join(right, "lemma_b", "left")
    return joined.select("lemma_a", "lemma_b", F.get(F.array_intersect("ka", "kb"), F.lit(0)).alias("kind"))


def sense_pairs(pairs: DataFrame, senses: DataFrame) -> DataFrame:
    """Nodes ``a``/``b`` of the first senses of two lemmas in their first shared kind."""
    first = senses.where("sense = 1")
    left = first.select(F.col("lemma").alias("lemma_a"), "kind", F.col("node").alias("a"))
    right = first.select(F.col("lemma").alias("lemma_b"), "kind", F.col("node").alias("b"))
    return (
        common_kind(pairs, senses)
        .join(left, ["lemma_a", "kind"], "left")
        .join(right, ["lemma_b", "kind"], "left")
    )


def word_similarity(pairs: DataFrame, senses: DataFrame, up: DataFrame) -> DataFrame:
    """Path similarity 1 / (1 + distance) of lemma pairs; 0 without a shared kind or path.

    The first senses of a lemma are placed in the hierarchy before the pairs meet them, so a pair is
    looked up once for each lemma: rows of :func:`sense_pairs` without further joins.
    """
    nodes, lists = _placed(up)
    first = senses.where("sense = 1").select("lemma", "kind", "node")
    placed = salted_join(first, nodes.select("node", "above"), ["node"], "node", F.col("lemma"), how="left")
    kept = F.collect_list(F.struct("kind", "node", "above"))
    own = kinds(senses).join(placed.groupBy("lemma").agg(kept.alias("first")), "lemma", "left")
    own = written(own, "lemmas")

    def at(x):
        return own.select(F.col("lemma").alias(f"lemma_{x}"), F.col("kinds").alias(f"kinds_{x}"), F.col("first").alias(f"first_{x}"))

    joined = pairs.join(at("a"), "lemma_a", "left").join(at("b"), "lemma_b", "left")
    joined = joined.withColumn("kind", F.get(F.array_intersect("kinds_a", "kinds_b"), F.lit(0)))
    for x in ("a", "b"):
        of_kind = F.filter(f"first_{x}", lambda s: s["kind"] == F.col("kind"))
        joined = joined.withColumn("s", F.explode_outer(of_kind)).withColumns(
            {x: F.col("s.node"), f"above_{x}": F.col("s.above"), f"of_{x}": F.lit(None).cast("double")}
        )
    path = 1 / (1 + F.col("best.da") + F.col("best.db"))
    return _nearest(joined, lists).select("lemma_a", "lemma_b", F.coalesce(path, F.lit(0.0)).alias("similarity"))


def _valued(lca: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs of ``lca`` with ``of_a, of_b, of_lca``, where all three are known.

    They are looked up in ``values`` ``(node, value)`` unless :func:`common_ancestor` brought them.
    """
    names = ("a", "b", "lca")
    if "of_lca" not in lca.columns:
        pairs = lca = written(lca, "lca")
        for name, by in zip(names, ("b", "a", "a")):
            one = values.select(F.col("node").alias(name), F.col("value").alias(f"of_{name}"))
            lca = salted_join(lca, one, [name], name, F.col(by), counted=pairs)
    return lca.where(" AND ".join(f"of_{name} IS NOT NULL" for name in names))


def depth_similarities(lca: DataFrame, depths: DataFrame) -> DataFrame:
    """Wu-Palmer and Leacock-Chodorow of the pairs in ``lca``."""
    deepest = depths.agg(F.max("depth_max"))
    joined = _valued(lca, depths.select("node", F.col("depth_max").alias("value")))
    path_nodes = F.col("da") + F.col("db") + 1
    return joined.select(
        "a",
        "b",
        "lca",
        F.try_divide(2.0 * F.col("of_lca"), F.col("of_a") + F.col("of_b")).alias("wup"),
        (-F.log(path_nodes / (2.0 * deepest.scalar()))).alias("lch"),
    )


def information(counts: DataFrame, up: DataFrame) -> DataFrame:
    """``(node, ic)`` = -ln of the share of all occurrences found at or below a node."""
    rolled = (
        up.join(counts, "node").groupBy(F.col("anc").alias("node")).agg(F.sum("n").alias("n"))
    )
    total = counts.agg(F.sum("n"))
    return rolled.where("n > 0").select("node", (-F.log(F.col("n") / total.scalar())).alias("ic"))


def content_similarities(lca: DataFrame, ic: DataFrame) -> DataFrame:
    """Resnik, Lin and Jiang-Conrath of the pairs in ``lca``."""
    joined = _valued(lca, ic.select("node", F.col("ic").alias("value")))
    both, shared = F.col("of_a") + F.col("of_b"), F.col("of_lca")
    return joined.select(
        "a",
        "b",
        shared.alias("res"),
        F.try_divide(2 * shared, both).alias("lin"),
        F.try_divide(F.lit(1.0), both - 2 * shared).alias("jcn"),
    )
