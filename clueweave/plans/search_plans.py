"""Search, solver and puzzle-store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clueweave.functions import text as T
from clueweave.operators import dictionary as D
from clueweave.operators import graph as G
from clueweave.operators import patterns as M
from clueweave.operators import puzzles as Z
from clueweave.operators import search as Q
from clueweave.plans import sqlparts as P
from clueweave.plans import standins as V
from clueweave.plans.graph_plans import (
    ASKED,
    ASKED_SQL,
    CHAT_GRAPH,
    TURN_GRAPH,
    V1_GRAPH,
    V2_GRAPH,
    chat_graph_v2,
    summed_pairs,
)
from clueweave.plans.registry import query
from clueweave.session import written

SEED = "11"

ITEMS = """items AS (
  SELECT l_orderkey AS cwid, l_partkey AS wid, l_linenumber AS x, CAST(l_suppkey % 7 AS INTEGER) AS y,
         upper(replace(p_name, ' ', '')) AS word, p_type AS clue,
         CASE WHEN l_partkey % 2 = 0 THEN 'East' ELSE 'South' END AS dir
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

#: every benchmark item is a query of its tokens
ASKED_ITEMS = f"""asked AS (
  SELECT DISTINCT item_id AS qid, unnest(string_split({P.norm('text')}, ' ')) AS word FROM benchmark)"""


def asked_items(spark, folder):
    return V.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"), F.explode(T.tokens(T.normalize(F.col("text")))).alias("word")
    )


def chat_graph(spark, folder):
    """The stored graph: searches read it several times, so it is written once."""
    return written(V.graph_v1(V.chat_page_text(spark, folder)), "graph")


@query(
    "graph_search",
    P.with_(*P.V1_GRAPH, P.DICTIONARY)
    + f"""SELECT s.wid AS wid, s.word AS word, CAST(sum(micro) AS BIGINT) AS score
          FROM graph JOIN dictionary d ON d.word = dst JOIN dictionary s ON s.word = src
          WHERE d.word IN ({ASKED_SQL}) GROUP BY s.wid, s.word ORDER BY score DESC, word LIMIT 10""",
)
def graph_search(spark, folder):
    summed = summed_pairs(spark, folder)
    words = D.build(D.vocabulary(summed))
    neighbors = D.to_index(G.normalise(summed), words)
    return Q.associate_indexed(words, neighbors, ASKED, "micro", 10)


@query(
    "graph_search_dist1",
    P.with_(*V2_GRAPH)
    + f"""SELECT src AS word, CAST(sum(tenths) AS BIGINT) AS score FROM graph
          WHERE dst IN ({ASKED_SQL}) GROUP BY src ORDER BY score DESC, word LIMIT 5""",
)
def graph_search_dist1(spark, folder):
    return Q.associate(chat_graph_v2(spark, folder), ASKED, "tenths", 5)


DIST2 = """direct AS (
  SELECT DISTINCT qid, word AS origin, src, tenths FROM asked JOIN graph ON dst = word),
paths AS (
  SELECT qid, src, origin, 2 * tenths AS w2 FROM direct
  UNION ALL
  SELECT d.qid, g.src, d.origin, g.tenths FROM direct d JOIN graph g ON g.dst = d.src WHERE d.tenths = 10),
best AS (SELECT qid, src, origin, max(w2) AS w2 FROM paths GROUP BY qid, src, origin),
scores AS (SELECT qid, src AS word, CAST(sum(w2) AS BIGINT) AS score2 FROM best GROUP BY qid, src),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score2 DESC, word) AS rank FROM scores)"""


@query(
    "graph_search_dist2",
    P.with_(*V2_GRAPH, ASKED_ITEMS, DIST2)
    + """SELECT qid, word, score2 / 20.0::DOUBLE AS score, CAST(rank AS INTEGER) AS rank
         FROM ranked WHERE rank <= 5""",
)
def graph_search_dist2(spark, folder):
    best = Q.distance_two_top_k(
        written(chat_graph_v2(spark, folder), "graph"),
        asked_items(spark, folder),
        "tenths",
        certain=10,
        k=5,
    )
    return best.select("qid", "word", (F.col("score2") / 20.0).alias("score"), "rank")


BEST_SQL = """, scores AS (SELECT qid, src AS word, CAST(sum(micro) AS BIGINT) AS score
           FROM asked JOIN graph ON dst = word GROUP BY qid, src)
         SELECT qid, word, score, CAST(rank AS INTEGER) AS rank FROM (
           SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, word) AS rank FROM scores)
         WHERE rank <= 10"""
BATCH_SQL = P.with_(*CHAT_GRAPH, ASKED_ITEMS) + BEST_SQL


@query("search_batch_topk", BATCH_SQL)
def search_batch_topk(spark, folder):
    return Q.batch_top_k(chat_graph(spark, folder), asked_items(spark, folder), "micro", 10)


@query("search_batch_indexed", P.with_(*TURN_GRAPH, ASKED_ITEMS) + BEST_SQL)
def search_batch_indexed(spark, folder):
    """The batch over the graph of the conversations alone, in lists in blocks of falling weight."""
    graph = written(V.graph_v1(V.chat_text(spark, folder)), "graph")
    return Q.batch_top_k_indexed(graph, asked_items(spark, folder), "micro", 10)


@query(
    "page_search_topk",
    P.with_(P.PAGE_TEXT, P.BAGS, P.WEIGHTS_V1, P.EDGES_V1, P.SUMMED, P.GRAPH_V1, ASKED_ITEMS) + BEST_SQL,
)
def page_search_topk(spark, folder):
    """The same batch over the graph of the visible text of whole pages."""
    graph = written(V.graph_v1(V.page_text(spark, folder)), "graph")
    return Q.batch_top_k(graph, asked_items(spark, folder), "micro", 10)


PATTERNS = ("th*e?", "?e?", "*ING", "q*")


@query(
    "pattern_search",
    P.with_(P.BAG_TEXT, P.BAGS)
    + """, vocab AS (SELECT DISTINCT unnest(toks) AS word FROM bag_tokens),
         hits AS (SELECT p.pattern, word, row_number() OVER (PARTITION BY p.pattern ORDER BY word) AS rn
           FROM vocab, (VALUES ('th*e?', '^TH.*E.$'), ('?e?', '^.E.$'), ('*ING', '^.*ING$'), ('q*', '^Q.*$'))
             AS p(pattern, regex) WHERE regexp_matches(word, regex))
         SELECT pattern, word FROM hits WHERE rn <= 20""",
)
def pattern_search(spark, folder):
    vocabulary = V.vocabulary(V.document_text(spark, folder)).withColumnRenamed("form", "word")
    words = written(vocabulary, "words")
    out = None
    for pattern in PATTERNS:
        found = M.pattern_search(words, pattern).select(F.lit(pattern).alias("pattern"), "word")
        out = found if out is None else out.union(found)
    return out


@query(
    "associate_pattern_search",
    V1_GRAPH
    + f"""SELECT src AS word, CAST(sum(micro) AS BIGINT) AS score FROM graph
          WHERE dst IN ({ASKED_SQL}) AND regexp_matches(src, '^T.*E.$')
          GROUP BY src ORDER BY score DESC, word LIMIT 20""",
)
def associate_pattern_search(spark, folder):
    graph = V.graph_v1(V.document_text(spark, folder))
    return M.associate_pattern(graph, ASKED, "t*e?", "micro", 20)


#: one request per benchmark item: its first word with every second letter hidden and no
#: clue, the same ending with its text as the clue, and an entry without a pattern
REQUESTS = f"""asked_text AS (
  SELECT item_id AS rid, {P.norm('text')} AS ntext FROM benchmark),
request_words AS (SELECT rid, ntext, string_split(ntext, ' ') AS toks FROM asked_text),
entries AS (
  SELECT rid, 0 AS ord, 'a1' AS pos, regexp_replace(toks[1], '(.).', '\\1?', 'g') AS pattern, '' AS clue
  FROM request_words
  UNION ALL
  SELECT rid, 1, 'd2', '*' || right(toks[2], 1), ntext FROM request_words)"""


def solver_requests(spark, folder):
    text = T.normalize(F.col("text"))
    rows = V.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("rid"), text.alias("ntext"), F.split(text, " ").alias("toks")
    )
    hidden = F.regexp_replace(F.get("toks", F.lit(0)), "(.).", "$1?")
    ending = F.concat(F.lit("*"), F.right(F.get("toks", F.lit(1)), F.lit(1)))
    request = F.concat(
        F.lit("a1-"), hidden, F.lit("-;d2-"), ending, F.lit("-"), F.col("ntext"), F.lit(";a3")
    )
    return rows.select("rid", request.alias("request"))


@query(
    "solver_batch",
    P.with_(*CHAT_GRAPH, REQUESTS)
    + """, vocab AS (SELECT src AS word FROM graph UNION SELECT dst FROM graph),
         cleaned AS (SELECT rid, ord, pos, regexp_replace(pattern, '[^A-Z*?]', '', 'g') AS pattern, clue
                     FROM entries),
         regexes AS (SELECT rid, ord, pos, clue,
                       '^' || replace(replace(pattern, '*', '.*'), '?', '.') || '$' AS regex
                     FROM cleaned WHERE pattern <> ''),
         plain AS (SELECT rid, ord, pos, word, row_number() OVER (PARTITION BY rid, ord ORDER BY word) AS rank
                   FROM regexes, vocab WHERE clue = '' AND regexp_matches(word, regex)),
         clue_words AS (SELECT DISTINCT rid, ord, unnest(string_split(clue, ' ')) AS word
                        FROM regexes WHERE clue <> ''),
         scores AS (SELECT rid, ord, src AS word, sum(micro) AS score
                    FROM clue_words JOIN graph ON dst = word GROUP BY rid, ord, src),
         clued AS (SELECT s.rid, s.ord, pos, word,
                     row_number() OVER (PARTITION BY s.rid, s.ord ORDER BY score DESC, word) AS rank
                   FROM scores s JOIN regexes r ON r.rid = s.rid AND r.ord = s.ord
                   WHERE regexp_matches(word, regex)),
         listed AS (SELECT rid, ord, pos, pos || '-' || string_agg(word, ',' ORDER BY rank) AS txt
                    FROM (SELECT * FROM plain UNION ALL SELECT * FROM clued)
                    WHERE rank <= 20 GROUP BY rid, ord, pos)
         SELECT rid, string_agg(txt, ';' ORDER BY ord) AS answer FROM listed GROUP BY rid""",
)
def solver_batch(spark, folder):
    graph = chat_graph(spark, folder)
    words = written(D.vocabulary(graph), "words")
    return M.solve(solver_requests(spark, folder), words, graph, "micro")


@query("clue_from_word", P.with_(ITEMS) + "SELECT word, clue FROM items WHERE word = 'HOTGEAR'")
def clue_from_word(spark, folder):
    return Z.clues_of(V.placed_words(spark, folder), "HOTGEAR")


@query(
    "clues_for_words",
    P.with_(ITEMS)
    + """, asked AS (SELECT DISTINCT unnest([split_part(upper(p_name), ' ', 1), upper(replace(p_name, ' ', ''))]) AS word FROM part)
         SELECT a.word, coalesce(min(clue), 'No clue found') AS clue
         FROM asked a LEFT JOIN items i ON i.word = a.word GROUP BY a.word""",
)
def clues_for_words(spark, folder):
    asked = V.table(spark, folder, "part").select(
        F.explode(
            F.array(F.substring_index(F.upper("p_name"), " ", 1), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))))
        ).alias("word")
    )
    return Z.clue_for_each(asked.distinct(), V.placed_words(spark, folder))


@query(
    "puzzle_items",
    """SELECT l_orderkey AS cwid, l_partkey AS wid, l_linenumber AS x,
              upper(replace(p_name, ' ', '')) AS word, p_type AS clue
       FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def puzzle_items(spark, folder):
    items = V.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("cwid"), F.col("l_partkey").alias("wid"), F.col("l_linenumber").alias("x")
    )
    words = V.table(spark, folder, "part").select(
        F.col("p_partkey").alias("wid"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("word"),
        F.col("p_type").alias("clue"),
    )
    return Z.puzzle_items(items, words).select("cwid", "wid", "x", "word", "clue")


@query(
    "random_puzzle",
    P.with_(ITEMS)
    + f""", puzzles AS (SELECT DISTINCT cwid FROM items),
          picked AS (SELECT cwid FROM puzzles ORDER BY md5('{SEED}' || cwid), cwid LIMIT 5)
          SELECT cwid, '{{"word":"' || word || '","clue":"' || clue || '","x":' || x || ',"y":' || y ||
                 ',"dir":"' || dir || '"}}' AS item FROM items JOIN picked USING (cwid)""",
)
def random_puzzle(spark, folder):
    items = V.placed_words(spark, folder)
    picked = Z.shuffled(items.select("cwid").distinct(), "cwid", 5, SEED)
    return Z.item_json(items.join(picked, "cwid")).select("cwid", "item")


@query(
    "random_words",
    P.with_(P.CHAT_TEXT, P.BAGS)
    + f""", vocab AS (SELECT DISTINCT unnest(toks) AS word FROM bag_tokens)
          SELECT word FROM vocab WHERE regexp_matches(word, '^[a-zA-Z]+$')
          ORDER BY md5('{SEED}' || word), word LIMIT 20""",
)
def random_words(spark, folder):
    words = V.vocabulary(V.chat_text(spark, folder)).withColumnRenamed("form", "word")
    return Z.shuffled(Z.letter_words(words), "word", 20, SEED)


#: held-out entries: the benchmark entries are the test rows, all other bags the training rows
HELD_OUT = """expected AS (
  SELECT concat_ws(':', src_id, win) AS qid, words[1] AS word FROM all_bags WHERE category = 'equivalents'),
asked AS (
  SELECT DISTINCT concat_ws(':', src_id, win) AS qid, unnest(defs) AS word
  FROM all_bags WHERE category = 'equivalents')"""
TRAIN_BAGS = P.BAGS.replace("clean_bags AS (", "all_bags AS (") + """,
clean_bags AS (SELECT * FROM all_bags WHERE category <> 'equivalents')"""
EVALUATE = """SELECT CAST(count(*) AS BIGINT) AS n_queries, CAST(count(h.qid) AS BIGINT) AS n_hits,
  count(h.qid) / count(*) AS "precision"
  FROM expected e LEFT JOIN (SELECT qid, word FROM ranked WHERE rank <= 5) h
    ON h.qid = e.qid AND h.word = e.word"""


def held_out(bags):
    test = bags.where("category = 'equivalents'").withColumn("qid", F.concat_ws(":", "src_id", "win"))
    return (
        bags.where("category <> 'equivalents'"),
        test.select("qid", F.explode("defs").alias("word")),
        test.select("qid", F.get("words", F.lit(0)).alias("word")),
    )


@query(
    "eval_hits_at_5",
    P.with_(*(c if c is not P.BAGS else TRAIN_BAGS for c in V2_GRAPH), HELD_OUT, DIST2) + EVALUATE,
)
def eval_hits_at_5(spark, folder):
    source = V.chat_page_text(spark, folder)
    _, asked, expected = held_out(V.clean_bags(source))
    train = V.stemmed_bags(source, keep="category <> 'equivalents'")
    graph = written(G.combine_max_v2(train), "graph")
    return Q.hit_rate(Q.distance_two_top_k(graph, asked, "tenths", 10, 5), expected)


@query(
    "eval_precision_at_5",
    P.with_(*(c if c is not P.BAGS else TRAIN_BAGS for c in TURN_GRAPH), HELD_OUT)
    + """, scores AS (SELECT qid, src AS word, sum(micro) AS score
           FROM asked JOIN graph ON dst = word GROUP BY qid, src),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, word) AS rank
           FROM scores) """
    + EVALUATE,
)
def eval_precision_at_5(spark, folder):
    train, asked, expected = held_out(V.clean_bags(V.chat_text(spark, folder)))
    graph = written(G.combine_norm(G.word_def_edges(V.B.weigh(train))), "graph")
    return Q.hit_rate(Q.batch_top_k(graph, asked, "micro", 5), expected)
