"""Puzzle grid and integrity queries over line items placed as words."""

from __future__ import annotations

from pyspark.sql import functions as F

from clueweave.operators import bags as B
from clueweave.operators import dictionary as D
from clueweave.operators import grid as R
from clueweave.operators import integrity as K
from clueweave.plans import sqlparts as P
from clueweave.plans import standins as V
from clueweave.plans.graph_plans import CHAT_GRAPH
from clueweave.plans.registry import query
from clueweave.plans.search_plans import ITEMS, SEED, chat_graph
from clueweave.plans.text_plans import LINES, puzzles

LETTERS = """letters AS (
  SELECT cwid, wid, CASE dir WHEN 'East' THEN x + i ELSE x END AS x,
         CASE dir WHEN 'South' THEN y + i ELSE y END AS y, letter
  FROM (SELECT cwid, wid, x, y, dir, unnest(string_split(word, '')) AS letter,
               CAST(unnest(range(length(word))) AS INTEGER) AS i FROM items)),
cells AS (SELECT cwid, x, y, min(letter) AS letter FROM letters GROUP BY cwid, x, y),
conflicts AS (SELECT cwid, x, y, CAST(count(DISTINCT letter) AS INTEGER) AS n_letters FROM letters
              GROUP BY cwid, x, y HAVING count(DISTINCT letter) > 1),
extents AS (SELECT cwid,
    CAST(max(x + CASE dir WHEN 'East' THEN length(word) - 1 ELSE 0 END) + 1 AS INTEGER) AS width,
    CAST(max(y + CASE dir WHEN 'South' THEN length(word) - 1 ELSE 0 END) + 1 AS INTEGER) AS height
  FROM items GROUP BY cwid),
uniq AS (SELECT cwid, x, y, dir, min(ROW(word, clue)) AS e FROM items GROUP BY cwid, x, y, dir),
starts AS (SELECT cwid, x, y, row_number() OVER (PARTITION BY cwid ORDER BY y, x) AS number
           FROM (SELECT DISTINCT cwid, x, y FROM items)),
isl AS (
  SELECT cwid, x, y, letter, 'East' AS dir, y AS line,
         x - row_number() OVER (PARTITION BY cwid, y ORDER BY x) AS island, x AS spot FROM cells
  UNION ALL
  SELECT cwid, x, y, letter, 'South', x,
         y - row_number() OVER (PARTITION BY cwid, x ORDER BY y), y FROM cells),
found AS (SELECT cwid, min(x) AS x, min(y) AS y, string_agg(letter, '' ORDER BY spot) AS word, dir
          FROM isl GROUP BY cwid, dir, line, island HAVING count(*) >= 2)"""

GRID = P.with_(ITEMS, LETTERS)


@query("grid_cells", GRID + "SELECT cwid, wid, x, y, letter FROM letters")
def grid_cells(spark, folder):
    return R.letters(V.placed_words(spark, folder), "wid").select("cwid", "wid", "x", "y", "letter")


@query("grid_conflicts", GRID + "SELECT cwid, x, y, n_letters FROM conflicts")
def grid_conflicts(spark, folder):
    return R.conflicts(V.placed_words(spark, folder))


@query(
    "grid_extents",
    GRID
    + """SELECT e.cwid, width, height, width * height - c.n AS n_black
         FROM extents e JOIN (SELECT cwid, count(*) AS n FROM cells GROUP BY cwid) c ON c.cwid = e.cwid""",
)
def grid_extents(spark, folder):
    items = V.placed_words(spark, folder)
    filled = R.cells(items).groupBy("cwid").agg(F.count(F.lit(1)).alias("n"))
    return R.extents(items).join(filled, "cwid").select(
        "cwid", "width", "height", (F.col("width") * F.col("height") - F.col("n")).alias("n_black")
    )


@query(
    "grid_lines",
    GRID
    + """, rows_ AS (SELECT cwid, width, CAST(unnest(range(height)) AS INTEGER) AS y FROM extents),
         spots AS (SELECT cwid, y, CAST(unnest(range(width)) AS INTEGER) AS x FROM rows_)
         SELECT s.cwid, s.y, string_agg(coalesce(letter, '.'), '' ORDER BY s.x) AS line
         FROM spots s LEFT JOIN cells c ON c.cwid = s.cwid AND c.x = s.x AND c.y = s.y GROUP BY s.cwid, s.y""",
)
def grid_lines(spark, folder):
    return R.lines(V.placed_words(spark, folder))


@query("grid_numbering", GRID + "SELECT cwid, x, y, CAST(number AS INTEGER) AS number FROM starts")
def grid_numbering(spark, folder):
    return R.numbering(V.placed_words(spark, folder))


@query(
    "grid_clue_lists",
    GRID
    + """SELECT u.cwid, CASE dir WHEN 'East' THEN 'across' ELSE 'down' END AS side,
                CAST(number AS INTEGER) AS number, e[1] AS word, e[2] AS clue
         FROM uniq u JOIN starts s ON s.cwid = u.cwid AND s.x = u.x AND s.y = u.y""",
)
def grid_clue_lists(spark, folder):
    return R.clue_lists(V.placed_words(spark, folder))


@query("grid_words_from_cells", GRID + "SELECT cwid, x, y, word, dir FROM found")
def grid_words_from_cells(spark, folder):
    return R.words_from_cells(R.grids(V.placed_words(spark, folder)))


SPANS = """spans AS (
  SELECT DISTINCT cwid, x AS x1, y AS y1,
         CAST(x + CASE dir WHEN 'East' THEN length(word) - 1 ELSE 0 END AS INTEGER) AS x2,
         CAST(y + CASE dir WHEN 'South' THEN length(word) - 1 ELSE 0 END AS INTEGER) AS y2 FROM items)"""


@query(
    "grid_word_rebuild",
    P.with_(ITEMS, LETTERS, SPANS)
    + """SELECT s.*, string_agg(letter, '' ORDER BY c.x, c.y) AS word
         FROM spans s JOIN cells c ON c.cwid = s.cwid AND c.x BETWEEN x1 AND x2 AND c.y BETWEEN y1 AND y2
         GROUP BY ALL""",
)
def grid_word_rebuild(spark, folder):
    def span(e):
        reach = F.length(e["word"]) - 1
        east = e["dir"] == "East"
        return F.struct(
            e["x"].alias("x1"),
            e["y"].alias("y1"),
            (e["x"] + F.when(east, reach).otherwise(0)).alias("x2"),
            (e["y"] + F.when(east, 0).otherwise(reach)).alias("y2"),
        )

    puzzles = R.grids(V.placed_words(spark, folder))
    return R.rebuilt(puzzles.withColumn("spans", F.array_distinct(F.transform("items", span))))


#: line items as words, some of them emptied or turned, and whole puzzles of empty words
BROKEN = (
    GRID.replace(ITEMS, ITEMS.replace("items AS (", "whole AS (") + """,
placed AS (
  SELECT cwid, wid, x, y, CASE WHEN wid % 41 = 0 OR cwid % 101 = 0 THEN '' ELSE word END AS word, clue,
         CASE WHEN wid % 37 = 0 THEN 'North' WHEN wid % 43 = 0 THEN NULL ELSE dir END AS dir FROM whole),
items AS (SELECT * FROM placed WHERE dir IN ('East', 'South'))""")
    .replace("FROM items)),", "FROM items WHERE word <> '')),")
)


@query(
    "grid_validation",
    BROKEN
    + """SELECT cwid, 'overlap' AS rule, count(*) AS n FROM conflicts GROUP BY cwid
         UNION ALL
         SELECT g.cwid, 'clue count', abs(g.n - coalesce(f.n, 0))
         FROM (SELECT cwid, count(*) AS n FROM uniq GROUP BY cwid) g
         LEFT JOIN (SELECT cwid, count(*) AS n FROM found GROUP BY cwid) f ON f.cwid = g.cwid
         WHERE g.n <> coalesce(f.n, 0)
         UNION ALL SELECT cwid, 'empty word', count(*) FROM placed WHERE word = '' GROUP BY cwid
         UNION ALL SELECT cwid, 'direction', count(*) FROM placed
                   WHERE dir IS NULL OR dir NOT IN ('East', 'South') GROUP BY cwid
         UNION ALL SELECT cwid, 'empty grid', CAST(1 AS BIGINT) FROM placed GROUP BY cwid
                   HAVING count(*) FILTER (dir IN ('East', 'South') AND word <> '') = 0""",
)
def grid_validation(spark, folder):
    """All rules over puzzles of which some are broken on purpose."""
    wid, emptied = F.col("wid"), (F.col("wid") % 41 == 0) | (F.col("cwid") % 101 == 0)
    items = V.placed_words(spark, folder).withColumns(
        {
            "word": F.when(emptied, "").otherwise(F.col("word")),
            "dir": F.when(wid % 37 == 0, "North").when(wid % 43 != 0, F.col("dir")),
        }
    )
    return R.validation(items)


@query("grid_cell_count", GRID + "SELECT cwid, count(*) AS missing FROM conflicts GROUP BY cwid")
def grid_cell_count(spark, folder):
    """Grids whose size, black cells and undisputed letters do not add up."""
    return R.gaps(R.cell_counts(V.placed_words(spark, folder)))


@query(
    "clue_fanout",
    """SELECT p_partkey AS cwid, p_type AS clue, unnest(string_split(p_name, ' ')) AS word,
              unnest(['across', 'down'][1:len(string_split(p_name, ' '))]) AS dir,
              unnest([p_size, p_size + 1][1:len(string_split(p_name, ' '))]) AS x FROM part""",
)
def clue_fanout(spark, folder):
    words = F.split("p_name", " ")
    shared = V.table(spark, folder, "part").select(
        F.col("p_partkey").alias("cwid"),
        F.col("p_type").alias("clue"),
        words.alias("word"),
        F.slice(F.array(F.lit("across"), F.lit("down")), F.lit(1), F.size(words)).alias("dir"),
        F.slice(F.array(F.col("p_size"), F.col("p_size") + 1), F.lit(1), F.size(words)).alias("x"),
    )
    return R.fan_out(shared, "word", "dir", "x")


@query(
    "crossing_candidates",
    P.with_(ITEMS)
    + """, puzzle_words AS (SELECT DISTINCT cwid, word FROM items),
         a AS (SELECT cwid, word, unnest(string_split(word, '')) AS letter,
                      CAST(unnest(range(length(word))) AS INTEGER) AS pos FROM puzzle_words),
         b AS (SELECT cwid, word AS next_word, unnest(string_split(word, '')) AS letter,
                      CAST(unnest(range(length(word))) AS INTEGER) AS next_pos FROM puzzle_words)
         SELECT cwid, word, next_word, letter, pos, next_pos FROM a JOIN b USING (cwid, letter)
         WHERE word < next_word""",
)
def crossing_candidates(spark, folder):
    """Where any two words of a puzzle can cross."""
    words = V.placed_words(spark, folder).select("cwid", "word")
    return R.crossings(words, words).where("word < next_word")


@query(
    "crossing_counts",
    P.with_(*CHAT_GRAPH)
    + """, vocab AS (SELECT src AS word FROM graph UNION SELECT dst FROM graph),
         spelled AS (SELECT word, unnest(string_split(word, '')) AS letter,
                            CAST(unnest(range(length(word))) AS INTEGER) AS pos FROM vocab),
         own AS (SELECT word, letter, count(*) AS own, min(pos) AS first_pos FROM spelled GROUP BY word, letter)
         SELECT word, letter, first_pos, CAST(sum(own) OVER (PARTITION BY letter) - own AS BIGINT) AS partners
         FROM own""",
)
def crossing_counts(spark, folder):
    return R.crossing_counts(D.vocabulary(chat_graph(spark, folder)))


@query(
    "generator_candidates",
    P.with_(LINES)
    + f""", fits AS (SELECT upper(replace(word, 'ß', 'ss')) AS word, clue FROM placed)
          SELECT word, regexp_replace(arg_min(clue, (md5('{SEED}' || word || clue), clue)),
                                      '[^A-Za-z0-9 ]', ' ', 'g') AS clue
          FROM fits WHERE regexp_matches(word, '^[A-Z]+$') AND length(word) BETWEEN 2 AND 17
            AND length(clue) < 100 AND trim(clue) <> '' GROUP BY word""",
)
def generator_candidates(spark, folder):
    pairs = B.clues(puzzles(spark, folder)).withColumn(
        "word", F.upper(F.replace("word", F.lit("ß"), F.lit("ss")))
    )
    return R.generator_candidates(pairs, SEED)


@query(
    "integrity_pk",
    P.with_(ITEMS)
    + """SELECT 'items(cwid,x,y,dir)' AS "constraint", count(*) AS violations FROM (
           SELECT 1 FROM items GROUP BY cwid, x, y, dir HAVING count(*) > 1)
         UNION ALL SELECT 'words(wid)', count(*) FROM (
           SELECT 1 FROM part GROUP BY p_partkey HAVING count(*) > 1)
         UNION ALL SELECT 'words(word)', count(*) FROM (
           SELECT 1 FROM part GROUP BY upper(replace(p_name, ' ', '')) HAVING count(*) > 1)
         UNION ALL SELECT 'puzzles(cwid)', count(*) FROM (
           SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""",
)
def integrity_pk(spark, folder):
    parts = V.table(spark, folder, "part").select(
        F.col("p_partkey").alias("wid"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("word")
    )
    orders = V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("cwid"))
    return K.primary_keys(
        [
            ("items(cwid,x,y,dir)", V.placed_words(spark, folder), ["cwid", "x", "y", "dir"]),
            ("words(wid)", parts, ["wid"]),
            ("words(word)", parts, ["word"]),
            ("puzzles(cwid)", orders, ["cwid"]),
        ]
    )


@query(
    "integrity_fk",
    P.with_(*CHAT_GRAPH)
    + """SELECT 'items.wid' AS "constraint", count(*) AS violations FROM lineitem
           WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
         UNION ALL SELECT 'items.cwid', count(*) FROM lineitem
           WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
         UNION ALL SELECT 'labels.doc_id', count(*) FROM labels
           WHERE doc_id NOT IN (SELECT doc_id FROM documents)
         UNION ALL SELECT 'neighbors.dst has entries', count(*) FROM graph
           WHERE dst NOT IN (SELECT src FROM graph)""",
)
def integrity_fk(spark, folder):
    t = {n: V.table(spark, folder, n) for n in ("lineitem", "part", "orders", "labels", "documents")}
    graph = chat_graph(spark, folder)
    sources = graph.select("src").distinct()
    return K.foreign_keys(
        [
            ("items.wid", t["lineitem"], "l_partkey", t["part"], "p_partkey"),
            ("items.cwid", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
            ("labels.doc_id", t["labels"], "doc_id", t["documents"], "doc_id"),
            ("neighbors.dst has entries", graph, "dst", sources, "src"),
        ]
    )


@query(
    "cascade_delete",
    P.with_(ITEMS)
    + """SELECT cwid, wid, x, y, word FROM items
         WHERE wid NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1')""",
)
def cascade_delete(spark, folder):
    gone = V.table(spark, folder, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("wid"))
    return K.cascade_delete(V.placed_words(spark, folder), gone, "wid").select("cwid", "wid", "x", "y", "word")
