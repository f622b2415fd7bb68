"""Bags, dictionary and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clueweave.operators import bags as B
from clueweave.operators import dictionary as D
from clueweave.operators import graph as G
from clueweave.operators import search as Q
from clueweave.operators import stems as S
from clueweave.plans import sqlparts as P
from clueweave.plans import standins as V
from clueweave.plans.registry import query
from clueweave.session import written

#: words of the fixed association query; they occur in all sizes of the driver data
ASKED = ["THE", "THING", "IDIOT", "PATHETIC", "NICHT", "QUE", "NOSUCHWORD"]
ASKED_SQL = ", ".join(f"'{w}'" for w in ASKED)

V1 = P.with_(*P.V1)
V1_GRAPH = P.with_(*P.V1_GRAPH)


@query(
    "bags_weighted",
    V1 + """SELECT category, src_id, win, array_to_string(words, ',') AS words,
           array_to_string(defs, ',') AS defs, CAST(tenths AS BIGINT) AS tenths
           FROM clean_bags JOIN weights USING (category)""",
)
def bags_weighted(spark, folder):
    rows = B.weigh(V.clean_bags(V.document_text(spark, folder)))
    return rows.withColumns(
        {"words": F.array_join("words", ","), "defs": F.array_join("defs", ",")}
    )


@query(
    "edges_weighted",
    V1 + """SELECT src, dst, CAST(count(*) AS BIGINT) AS n, CAST(sum(tenths) AS BIGINT) AS tenths
           FROM edges GROUP BY src, dst""",
)
def edges_weighted(spark, folder):
    edges = V.edges_v1(V.document_text(spark, folder))
    return edges.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tenths").alias("tenths")
    )


def summed_pairs(spark, folder):
    """Sums of the pairs with the largest sum of their source, stored."""
    return written(V.totals_v1(V.document_text(spark, folder)), "pairs")


@query("dictionary_build", P.with_(*P.V1, P.DICTIONARY) + "SELECT wid, word FROM dictionary")
def dictionary_build(spark, folder):
    return D.build(D.vocabulary(V.edges_v1(V.document_text(spark, folder))))


@query(
    "edges_indexed",
    P.with_(*P.V1, P.DICTIONARY, P.SUMMED)
    + """SELECT a.wid AS wid_from, b.wid AS wid_to, w
         FROM summed JOIN dictionary a ON a.word = src JOIN dictionary b ON b.word = dst""",
)
def edges_indexed(spark, folder):
    """Pairs are summed and written before they are read for the dictionary and the index."""
    summed = summed_pairs(spark, folder)
    return D.to_index(summed, D.build(D.vocabulary(summed))).select("wid_from", "wid_to", "w")


@query("graph_combine_norm", V1_GRAPH + "SELECT src, dst, micro FROM graph")
def graph_combine_norm(spark, folder):
    return V.graph_v1(V.document_text(spark, folder))


@query(
    "graph_combine_norm_all",
    P.with_(*P.V1, P.SUMMED)
    + """SELECT src, dst, CAST(1000000 * w // m AS BIGINT) AS micro
         FROM summed JOIN row_max USING (src)""",
)
def graph_combine_norm_all(spark, folder):
    return V.graph_v1(V.document_text(spark, folder), keep_weak=True)


@query(
    "associate_search",
    V1_GRAPH
    + f"""SELECT src AS word, CAST(sum(micro) AS BIGINT) / 1e6 AS score FROM graph
          WHERE dst IN ({ASKED_SQL}) GROUP BY src ORDER BY sum(micro) DESC, src LIMIT 20""",
)
def associate_search(spark, folder):
    graph = V.graph_v1(V.document_text(spark, folder))
    return Q.associate(graph, ASKED, "micro", 20).select(
        "word", (F.col("score") / 1e6).alias("score")
    )


STEMMED = """token_stem AS (
  SELECT v.form, coalesce(r.stem, v.form) AS stem FROM vocab v LEFT JOIN reduced r ON r.form = v.form),
long_bags AS (
  SELECT category, src_id, win, 'w' AS side, unnest(range(1, len(words)+1)) AS pos, unnest(words) AS form
  FROM clean_bags
  UNION ALL
  SELECT category, src_id, win, 'd', unnest(range(1, len(defs)+1)), unnest(defs) FROM clean_bags),
long_stems AS (SELECT l.*, t.stem FROM long_bags l JOIN token_stem t ON t.form = l.form),
exprs AS (SELECT category, src_id, win, array_to_string(words, ' ') AS expr FROM clean_bags)"""

#: the seven edge families of the second graph version (weights in tenths)
EDGES_V2 = """pairs_ns AS (SELECT form AS src, stem AS dst, 10 AS tenths FROM long_stems),
edges AS (
  SELECT src, dst, CAST(tenths AS BIGINT) AS tenths FROM (
    SELECT * FROM pairs_ns
    UNION ALL SELECT dst, src, tenths FROM pairs_ns
    UNION ALL SELECT a.stem, b.stem, CASE a.side WHEN 'w' THEN 6 ELSE 1 END
      FROM long_stems a JOIN long_stems b USING (category, src_id, win, side)
    UNION ALL SELECT l.stem, e.expr, CASE l.side WHEN 'w' THEN 6 ELSE 1 END
      FROM long_stems l JOIN exprs e USING (category, src_id, win)
    UNION ALL SELECT e.expr, l.stem, CASE l.side WHEN 'w' THEN 6 ELSE w.tenths END
      FROM long_stems l JOIN exprs e USING (category, src_id, win) JOIN weights w USING (category)))"""

GRAPH_V2 = """graph AS (
  SELECT src, dst, max(tenths) AS tenths FROM edges WHERE src <> dst GROUP BY src, dst)"""

CHAT = (P.CHAT_PAGES, P.BAGS, P.STEMS, STEMMED)
V2 = (*CHAT, P.WEIGHTS_V2, EDGES_V2)
V2_GRAPH = (*V2, GRAPH_V2)
CHAT_GRAPH = (P.CHAT_PAGES, P.BAGS, P.WEIGHTS_V1, P.EDGES_V1, P.SUMMED, P.GRAPH_V1)
#: the graph of the conversations and benchmark items alone
TURN_GRAPH = (P.CHAT_TEXT, *CHAT_GRAPH[1:])


def chat_graph_v2(spark, folder):
    return G.combine_max_v2(V.stemmed_bags(V.chat_page_text(spark, folder)))


@query(
    "edges_norm_stem",
    P.with_(*CHAT)
    + """SELECT src, dst, CAST(count(*) AS BIGINT) AS n, CAST(10 AS BIGINT) AS tenths FROM (
           SELECT form AS src, stem AS dst FROM long_stems
           UNION ALL SELECT stem, form FROM long_stems) GROUP BY src, dst""",
)
def edges_norm_stem(spark, folder):
    edges = G.norm_stem_edges(V.stemmed_bags(V.chat_page_text(spark, folder)))
    return edges.groupBy("src", "dst", "tenths").agg(F.count(F.lit(1)).alias("n"))


@query(
    "edges_v2_all",
    P.with_(*V2)
    + "SELECT src, dst, max(tenths) AS strongest, min(tenths) AS weakest FROM edges GROUP BY src, dst",
)
def edges_v2_all(spark, folder):
    return G.extremes_v2(V.stemmed_bags(V.chat_page_text(spark, folder)))


@query("graph_combine_max", P.with_(*V2_GRAPH) + "SELECT src, dst, tenths FROM graph")
def graph_combine_max(spark, folder):
    return chat_graph_v2(spark, folder)


@query(
    "graph_two_hop",
    P.with_(*CHAT_GRAPH)
    + """SELECT src, dst, max(w) AS w FROM (
           SELECT src, dst, micro * 1000000 AS w FROM graph
           UNION ALL
           SELECT a.src, b.dst, a.micro * b.micro FROM graph a JOIN graph b ON a.dst = b.src)
         WHERE w >= 100000000000 GROUP BY src, dst""",
)
def graph_two_hop(spark, folder):
    graph = written(V.graph_v1(V.chat_page_text(spark, folder)), "graph")
    return G.two_hop(graph, "micro", G.MICRO)


@query(
    "edge_words",
    P.with_(*P.V1_GRAPH, P.DICTIONARY)
    + """SELECT a.wid AS wid_from, src, b.wid AS wid_to, dst, micro FROM graph
         JOIN dictionary a ON a.word = src JOIN dictionary b ON b.word = dst""",
)
def edge_words(spark, folder):
    summed = summed_pairs(spark, folder)
    dictionary = D.build(D.vocabulary(summed))
    return D.edge_words(D.to_index(G.normalise(summed), dictionary), dictionary)


@query(
    "dictionary_get_id",
    P.with_(*P.V1, P.DICTIONARY, "asked AS (SELECT upper(lang) AS word FROM documents UNION ALL "
    "SELECT unnest(string_split(upper(p_name), ' ')) FROM part UNION ALL "
    f"SELECT unnest(string_split({P.norm('text')}, ' ')) FROM benchmark)")
    + "SELECT word, wid FROM asked JOIN dictionary USING (word)",
)
def dictionary_get_id(spark, folder):
    dictionary = D.build(D.vocabulary(V.edges_v1(V.document_text(spark, folder))))
    words = (
        V.table(spark, folder, "documents").select(F.upper("lang").alias("word"))
        .union(V.table(spark, folder, "part").select(F.explode(F.split(F.upper("p_name"), " "))))
        .union(V.table(spark, folder, "benchmark").select(F.explode(V.T.tokens(V.T.normalize(F.col("text"))))))
    )
    return D.get_id(words, dictionary)


@query(
    "dictionary_get_word",
    P.with_(*P.V1, P.DICTIONARY)
    + "SELECT wid, word FROM dictionary JOIN (SELECT o_custkey AS wid FROM orders) USING (wid)",
)
def dictionary_get_word(spark, folder):
    dictionary = D.build(D.vocabulary(V.edges_v1(V.document_text(spark, folder))))
    ids = V.table(spark, folder, "orders").select(F.col("o_custkey").alias("wid"))
    return D.get_word(ids, dictionary)


@query(
    "dictionary_labels",
    P.with_(*P.V1)
    + """, labels_only AS (SELECT DISTINCT src AS word FROM edges),
         numbered AS (SELECT row_number() OVER (ORDER BY word) - 1 AS wid, word FROM labels_only)
         SELECT wid, word, (SELECT max(wid) + 1 FROM numbered) AS n_classes FROM numbered""",
)
def dictionary_labels(spark, folder):
    edges = V.edges_v1(V.document_text(spark, folder))
    labels = D.build(edges, "src")
    classes = labels.agg((F.max("wid") + 1).alias("n"))
    return labels.withColumn("n_classes", classes.scalar())


@query(
    "max_id",
    """SELECT 'orders' AS tbl, coalesce(max(o_orderkey), -1) AS max_id FROM orders
       UNION ALL SELECT 'customer', coalesce(max(c_custkey), -1) FROM customer
       UNION ALL SELECT 'documents', coalesce(max(doc_id), -1) FROM documents
       UNION ALL SELECT 'none', coalesce(max(p_partkey), -1) FROM part WHERE p_size < 0""",
)
def max_id(spark, folder):
    parts = {
        "orders": (V.table(spark, folder, "orders"), "o_orderkey"),
        "customer": (V.table(spark, folder, "customer"), "c_custkey"),
        "documents": (V.table(spark, folder, "documents"), "doc_id"),
        "none": (V.table(spark, folder, "part").where("p_size < 0"), "p_partkey"),
    }
    out = None
    for name, (rows, field) in parts.items():
        one = D.max_id(rows, field).select(F.lit(name).alias("tbl"), "max_id")
        out = one if out is None else out.union(one)
    return out


@query(
    "stem_unstem_index",
    P.with_(P.BAG_TEXT, P.BAGS, P.STEMS)
    + "SELECT coalesce(r.stem, v.form) AS stem, v.form FROM vocab v LEFT JOIN reduced r USING (form)",
)
def stem_unstem_index(spark, folder):
    vocabulary = V.vocabulary(V.document_text(spark, folder))
    return S.stem_index(vocabulary, S.derive_stems(vocabulary))


@query(
    "stem_reduce",
    P.with_(P.CHAT_PAGES, P.BAGS, P.STEMS)
    + "SELECT v.form, coalesce(r.stem, v.form) AS stem FROM vocab v LEFT JOIN reduced r USING (form)",
)
def stem_reduce(spark, folder):
    vocabulary = V.vocabulary(V.chat_page_text(spark, folder))
    return S.reduce_forms(vocabulary, S.derive_stems(vocabulary))


@query(
    "stem_reduce_web",
    P.with_(P.CHAT_PAGES, P.BAGS, P.STEMS) + "SELECT form, stem FROM reduced",
)
def stem_reduce_web(spark, folder):
    vocabulary = V.vocabulary(V.chat_page_text(spark, folder))
    return S.reduce_forms_web(vocabulary, S.derive_stems(vocabulary))


@query(
    "text_clean",
    P.with_(P.CHAT_PAGES, P.BAGS, P.STEMS)
    + """SELECT category, src_id, string_agg(coalesce(r.stem, t.form), ' ' ORDER BY pos) AS cleaned
         FROM (SELECT category, src_id, unnest(toks) AS form, unnest(range(len(toks))) AS pos
               FROM bag_tokens) t LEFT JOIN reduced r USING (form) GROUP BY category, src_id""",
)
def text_clean(spark, folder):
    tokens = written(V.token_rows(V.chat_page_text(spark, folder)), "tokens")
    stems = S.derive_stems(V.each(tokens, "toks", "form").distinct())
    cleaned = S.stem_arrays(tokens, ["category", "src_id"], ["toks"], stems)
    return cleaned.select("category", "src_id", F.array_join("toks_stem", " ").alias("cleaned"))


@query(
    "page_vocabulary",
    P.with_(P.PAGE_TEXT, P.BAGS)
    + """SELECT category, form, CAST(count(*) AS BIGINT) AS n FROM (
           SELECT category, unnest(toks) AS form FROM bag_tokens) GROUP BY category, form""",
)
def page_vocabulary(spark, folder):
    """Words of the visible text of whole pages, counted per category."""
    tokens = V.token_rows(V.page_text(spark, folder))
    return V.each(tokens, "toks", "form", "category").groupBy("category", "form").agg(F.count(F.lit(1)).alias("n"))
