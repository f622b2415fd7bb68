"""Taxonomy queries: customers and suppliers below nations, regions and one root."""

from __future__ import annotations

from pyspark.sql import functions as F

from clueweave.operators import taxonomy as T
from clueweave.plans import standins as V
from clueweave.plans.registry import query
from clueweave.session import written

TAXONOMY = """tax AS (
  SELECT 'R' || r_regionkey AS child, 'ROOT' AS parent FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
paths AS (
  SELECT child AS node, parent AS anc, 1 AS dist FROM tax
  UNION ALL SELECT node, parent, dist + 1 FROM paths JOIN tax ON child = anc),
up AS (SELECT node, anc, min(dist) AS dist FROM paths GROUP BY node, anc
       UNION ALL SELECT node, node, 0 FROM (SELECT node FROM paths UNION SELECT anc FROM paths)),
depths AS (SELECT node, min(dist) AS depth_min, max(dist) AS depth_max FROM (
             SELECT node, dist FROM paths WHERE anc = 'ROOT' UNION ALL SELECT 'ROOT', 0) GROUP BY node)"""

PAIRS = """pairs AS (SELECT DISTINCT 'C' || o_custkey AS a, 'S' || l_suppkey AS b
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
common AS (SELECT p.a, p.b, u.anc, u.dist AS da, v.dist AS db FROM pairs p
  JOIN up u ON u.node = p.a JOIN up v ON v.node = p.b AND v.anc = u.anc),
lca AS (SELECT a, b, arg_min(anc, (da + db, anc)) AS lca, arg_min(da, (da + db, anc)) AS da,
               arg_min(db, (da + db, anc)) AS db FROM common GROUP BY a, b)"""

SENSES = """senses AS (
  SELECT c_name AS lemma, 'noun' AS kind, 1 AS sense, 'C' || c_custkey AS node FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT c_name, 'verb', 1, 'N' || c_nationkey FROM customer
  UNION ALL SELECT s_name, 'noun', 1, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT s_name, 'noun', 2, 'N' || s_nationkey FROM supplier
  UNION ALL SELECT s_name, 'adjective', 1, 'N' || s_nationkey FROM supplier),
names AS (SELECT DISTINCT c_name AS lemma_a, s_name AS lemma_b FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey)"""

TAX = f"WITH RECURSIVE {TAXONOMY} "


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def taxonomy(spark, folder):
    def level(name, child, parent):
        rows = V.table(spark, folder, name)
        return rows.select(child.alias("child"), parent.alias("parent"), F.lit("hypernym").alias("rel"))

    return (
        level("region", _id("R", "r_regionkey"), F.lit("ROOT"))
        .union(level("nation", _id("N", "n_nationkey"), _id("R", "n_regionkey")))
        .union(level("customer", _id("C", "c_custkey"), _id("N", "c_nationkey")))
        .union(level("supplier", _id("S", "s_suppkey"), _id("N", "s_nationkey")))
    )


def node_pairs(spark, folder):
    """Customer and supplier of every line item."""
    lines = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    orders = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, "o_orderkey").select("o_custkey", "l_suppkey").distinct()
    return written(both.select(_id("C", "o_custkey").alias("a"), _id("S", "l_suppkey").alias("b")), "pairs")


def senses(spark, folder):
    customers, suppliers = V.table(spark, folder, "customer"), V.table(spark, folder, "supplier")

    def part(rows, lemma, kind, sense, node):
        return rows.select(
            F.col(lemma).alias("lemma"), F.lit(kind).alias("kind"), F.lit(sense).alias("sense"), node.alias("node")
        )

    return (
        part(customers.where("c_acctbal >= 0"), "c_name", "noun", 1, _id("C", "c_custkey"))
        .union(part(customers, "c_name", "verb", 1, _id("N", "c_nationkey")))
        .union(part(suppliers, "s_name", "noun", 1, _id("S", "s_suppkey")))
        .union(part(suppliers, "s_name", "noun", 2, _id("N", "s_nationkey")))
        .union(part(suppliers, "s_name", "adjective", 1, _id("N", "s_nationkey")))
    )


def name_pairs(spark, folder):
    lines = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    orders = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    both = lines.join(orders, "o_orderkey").select("o_custkey", "l_suppkey").distinct()
    customers = V.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("lemma_a"))
    suppliers = V.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("lemma_b"))
    return both.join(customers, "o_custkey").join(suppliers, "l_suppkey").select("lemma_a", "lemma_b").distinct()


def ancestors(spark, folder):
    return written(T.with_self(T.closure(taxonomy(spark, folder))), "ancestors")


@query(
    "taxonomy_related",
    TAX
    + """, rel AS (SELECT child, parent, 'hypernym' AS rel, 'hyponym' AS back FROM tax
           UNION ALL SELECT 'P' || p_partkey, p_brand, 'part_holonym', 'part_meronym' FROM part)
         SELECT child AS node, rel, parent AS other FROM rel
         UNION SELECT parent, back, child FROM rel""",
)
def taxonomy_related(spark, folder):
    parts = V.table(spark, folder, "part").select(
        _id("P", "p_partkey").alias("child"), F.col("p_brand").alias("parent"), F.lit("part_holonym").alias("rel")
    )
    return T.related(taxonomy(spark, folder).union(parts))


@query("taxonomy_closure", TAX + "SELECT DISTINCT node, anc, dist FROM paths")
def taxonomy_closure(spark, folder):
    return T.closure(taxonomy(spark, folder))


@query("taxonomy_roots", TAX + "SELECT node, 'ROOT' AS root FROM depths")
def taxonomy_roots(spark, folder):
    return T.roots(T.closure(taxonomy(spark, folder)))


@query("taxonomy_depth", TAX + "SELECT node, depth_min, depth_max FROM depths")
def taxonomy_depth(spark, folder):
    return T.depth(T.closure(taxonomy(spark, folder)))


@query("taxonomy_lca", f"WITH RECURSIVE {TAXONOMY}, {PAIRS} SELECT a, b, lca, da, db FROM lca")
def taxonomy_lca(spark, folder):
    return T.common_ancestor(node_pairs(spark, folder), ancestors(spark, folder))


@query(
    "taxonomy_senses",
    f"""WITH {SENSES}, glosses AS (
          SELECT 'C' || c_custkey AS node, c_mktsegment || '; "' || c_name || '"; balance' AS gloss FROM customer
          UNION ALL SELECT 'S' || s_suppkey, 'supplier; "from ' || s_name || '"' FROM supplier
          UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation)
        SELECT lemma, kind, sense, s.node,
          CASE left(s.node, 1) WHEN 'C' THEN split_part(gloss, ';', 1) || '; balance'
            ELSE split_part(gloss, ';', 1) END AS definition,
          replace(trim(split_part(gloss, ';', 2)), '"', '') AS examples
        FROM senses s JOIN glosses g ON g.node = s.node""",
)
def taxonomy_senses(spark, folder):
    def gloss(name, node, text):
        return V.table(spark, folder, name).select(node.alias("node"), text.alias("gloss"))

    glosses = (
        gloss("customer", _id("C", "c_custkey"), F.concat("c_mktsegment", F.lit('; "'), "c_name", F.lit('"; balance')))
        .union(gloss("supplier", _id("S", "s_suppkey"), F.concat(F.lit('supplier; "from '), "s_name", F.lit('"'))))
        .union(gloss("nation", _id("N", "n_nationkey"), F.col("n_name")))
    )
    found = T.senses_with_gloss(senses(spark, folder), glosses)
    return found.withColumn("examples", F.array_join("examples", "; "))


KINDS = """kinds AS (SELECT lemma, list_sort(list(DISTINCT kind)) AS kinds FROM senses GROUP BY lemma),
shared AS (SELECT lemma_a, lemma_b, list_sort(list_intersect(x.kinds, y.kinds))[1] AS kind FROM names
  LEFT JOIN kinds x ON x.lemma = lemma_a LEFT JOIN kinds y ON y.lemma = lemma_b)"""


@query("taxonomy_common_kind", f"WITH {SENSES}, {KINDS} SELECT lemma_a, lemma_b, kind FROM shared")
def taxonomy_common_kind(spark, folder):
    return T.common_kind(name_pairs(spark, folder), senses(spark, folder))


@query(
    "taxonomy_edge_similarity",
    f"""WITH RECURSIVE {TAXONOMY}, {SENSES}, {KINDS},
        nodes AS (SELECT s.*, x.node AS a, y.node AS b FROM shared s
          LEFT JOIN senses x ON x.lemma = lemma_a AND x.kind = s.kind AND x.sense = 1
          LEFT JOIN senses y ON y.lemma = lemma_b AND y.kind = s.kind AND y.sense = 1),
        near AS (SELECT a, b, min(u.dist + v.dist) AS d FROM (SELECT DISTINCT a, b FROM nodes)
          JOIN up u ON u.node = a JOIN up v ON v.node = b AND v.anc = u.anc GROUP BY a, b)
        SELECT lemma_a, lemma_b, coalesce(1 / (1 + d), 0.0::DOUBLE) AS similarity
        FROM nodes n LEFT JOIN near m ON m.a = n.a AND m.b = n.b""",
)
def taxonomy_edge_similarity(spark, folder):
    return T.word_similarity(name_pairs(spark, folder), senses(spark, folder), ancestors(spark, folder))


@query(
    "taxonomy_wup_lch",
    f"""WITH RECURSIVE {TAXONOMY}, {PAIRS}
        SELECT l.a, l.b, l.lca, round(2.0::DOUBLE * m.depth_max / (x.depth_max + y.depth_max), 6) AS wup,
          round(-ln((da + db + 1) / (2.0::DOUBLE * (SELECT max(depth_max) FROM depths))), 6) AS lch
        FROM lca l JOIN depths x ON x.node = l.a JOIN depths y ON y.node = l.b JOIN depths m ON m.node = l.lca""",
)
def taxonomy_wup_lch(spark, folder):
    paths = T.closure(taxonomy(spark, folder))
    up, depths = written(T.with_self(paths), "ancestors"), written(T.depth(paths), "depths")
    values = depths.select("node", F.col("depth_max").alias("value"))
    found = T.depth_similarities(T.common_ancestor(node_pairs(spark, folder), up, values), depths)
    return found.select("a", "b", "lca", F.round("wup", 6).alias("wup"), F.round("lch", 6).alias("lch"))


@query(
    "taxonomy_ic",
    f"""WITH RECURSIVE {TAXONOMY}, {PAIRS},
        counts AS (SELECT 'C' || o_custkey AS node, count(*) AS n FROM orders GROUP BY o_custkey
          UNION ALL SELECT 'S' || l_suppkey, count(*) FROM lineitem GROUP BY l_suppkey),
        ic AS (SELECT anc AS node, ln((SELECT sum(n) FROM counts) / sum(n)) AS ic
          FROM up JOIN counts USING (node) GROUP BY anc)
        SELECT l.a, l.b, round(m.ic, 6) AS res, round(2 * m.ic / (x.ic + y.ic), 6) AS lin,
          round(1.0::DOUBLE / (x.ic + y.ic - 2 * m.ic), 6) AS jcn
        FROM lca l JOIN ic x ON x.node = l.a JOIN ic y ON y.node = l.b JOIN ic m ON m.node = l.lca""",
)
def taxonomy_ic(spark, folder):
    up = ancestors(spark, folder)

    def occurrences(name, prefix, key):
        counted = V.table(spark, folder, name).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return counted.select(_id(prefix, key).alias("node"), "n")

    counts = occurrences("orders", "C", "o_custkey").union(occurrences("lineitem", "S", "l_suppkey"))
    ic = written(T.information(counts, up), "ic")
    lca = T.common_ancestor(node_pairs(spark, folder), up, ic.select("node", F.col("ic").alias("value")))
    found = T.content_similarities(lca, ic)
    return found.select("a", "b", *[F.round(c, 6).alias(c) for c in ("res", "lin", "jcn")])
