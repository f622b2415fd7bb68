"""Text, bag and plain table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clueweave.functions import directions as R
from clueweave.functions import text as T
from clueweave.functions import vectors as X
from clueweave.operators import bags as B
from clueweave.operators import dictionary as D
from clueweave.operators import puzzles as Z
from clueweave.plans import sqlparts as P
from clueweave.plans import standins as V
from clueweave.plans.graph_plans import CHAT
from clueweave.plans.registry import query
from clueweave.session import fresh_path, spread
from clueweave.sources import bag_text


def documents(spark, folder):
    return spread(V.table(spark, folder, "documents"))


@query("text_normalize", f"SELECT doc_id, {P.norm('text')} AS ntext FROM documents")
def text_normalize(spark, folder):
    return documents(spark, folder).select("doc_id", T.normalize(F.col("text")).alias("ntext"))


@query(
    "text_normalize_web",
    f"""SELECT doc_id, regexp_replace({P.ascii_fold('text')}, '[^A-Z0-9_]', ' ', 'g') AS ntext
        FROM documents""",
)
def text_normalize_web(spark, folder):
    return documents(spark, folder).select("doc_id", T.normalize_web(F.col("text")).alias("ntext"))


@query(
    "text_to_ascii",
    f"""SELECT doc_id, trim(regexp_replace({P.escapes('text')}, '[^A-Z0-9]+', ' ', 'g')) AS ntext
        FROM documents""",
)
def text_to_ascii(spark, folder):
    return documents(spark, folder).select("doc_id", T.to_ascii(F.col("text")).alias("ntext"))


@query(
    "text_bound",
    """WITH a AS (SELECT page_id, CASE WHEN instr(html, '<article>') > 0
                    THEN substr(html, instr(html, '<article>')) ELSE html END AS tail FROM pages)
       SELECT page_id, CASE WHEN instr(tail, '</article>') > 0
         THEN substr(tail, 1, instr(tail, '</article>') - 1) ELSE tail END AS body FROM a""",
)
def text_bound(spark, folder):
    pages = V.table(spark, folder, "pages")
    return pages.select("page_id", T.bound(F.col("html"), "<article>", "</article>").alias("body"))


@query(
    "direction_parse",
    """SELECT o_orderkey,
         CASE lower(trim(d)) WHEN 'across' THEN 'East' WHEN 'east' THEN 'East' WHEN 'down' THEN 'South'
           WHEN 'south' THEN 'South' WHEN 'north' THEN 'North' WHEN 'west' THEN 'West' END AS dir
       FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' Across ' WHEN 'O' THEN 'DOWN'
               ELSE split_part(o_orderpriority, '-', 2) END AS d FROM orders)""",
)
def direction_parse(spark, folder):
    status = F.col("o_orderstatus")
    text = (
        F.when(status == "F", " Across ")
        .when(status == "O", "DOWN")
        .otherwise(F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(2)))
    )
    return V.table(spark, folder, "orders").select("o_orderkey", R.parse_direction(text).alias("dir"))


@query(
    "date_reformat",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
              strftime(o_orderdate, '%Y-%m-%d') AS compact_day FROM orders""",
)
def date_reformat(spark, folder):
    printed = F.concat(F.date_format("o_orderdate", "EEEE d MMMM y HH.mm"), F.lit(" GMT"))
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    return V.table(spark, folder, "orders").select(
        "o_orderkey",
        T.clue_date(printed).alias("day"),
        T.compact_date(compact).alias("compact_day"),
    )


@query(
    "category_rules",
    """SELECT p_partkey,
         CASE WHEN split_part(p_name, ' ', 1) = 'small' THEN 'cryptic' END AS from_title,
         CASE p_type WHEN 'SMALL' THEN 'straight' WHEN 'ECONOMY' THEN 'cryptic' ELSE p_type END AS from_url
       FROM part""",
)
def category_rules(spark, folder):
    title = F.regexp_replace("p_name", "^small ", "Quiptic ")
    part = (
        F.when(F.col("p_type") == "SMALL", "2s_straight")
        .when(F.col("p_type") == "ECONOMY", "2s_cryptic")
        .otherwise(F.col("p_type"))
    )
    return V.table(spark, folder, "part").select(
        "p_partkey",
        T.category_from_title(title).alias("from_title"),
        T.category_from_part(part).alias("from_url"),
    )


@query(
    "array_argmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS place
       FROM embeddings""",
)
def array_argmax(spark, folder):
    return V.table(spark, folder, "embeddings").select(
        "vec_id", X.argmax(F.col("embedding")).alias("place")
    )


@query(
    "vocabulary_size",
    P.with_(P.BAG_TEXT, P.BAGS)
    + """SELECT category, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT tok) AS BIGINT) AS n_words
         FROM (SELECT category, unnest(toks) AS tok FROM bag_tokens) GROUP BY category""",
)
def vocabulary_size(spark, folder):
    rows = V.token_rows(V.document_text(spark, folder))
    counts = rows.select("category", F.explode("toks").alias("tok")).groupBy("category", "tok").count()
    return counts.groupBy("category").agg(
        F.sum("count").alias("n_tokens"), F.count(F.lit(1)).alias("n_words")
    )


def puzzles(spark, folder):
    """Documents as puzzle records: one placed word per line, row by row."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.substring_index(line, " ", 1).alias("word"),
            F.regexp_replace(line, "^[^ ]* ?", "").alias("clue"),
            (i % 15).cast("int").alias("x"),
            F.floor(i / 15).cast("int").alias("y"),
            F.when(i % 2 == 0, "East").otherwise("South").alias("dir"),
        ),
    )
    return documents(spark, folder).select(
        F.col("doc_id").alias("cwid"),
        "source",
        F.col("lang").alias("language"),
        F.array("lang", "source").alias("categories"),
        lines.alias("words"),
    )


LINES = """doc_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
placed AS (
  SELECT doc_id AS cwid, split_part(line, ' ', 1) AS word, regexp_replace(line, '^[^ ]* ?', '') AS clue,
         CAST(i % 15 AS INTEGER) AS x, CAST(i // 15 AS INTEGER) AS y,
         CASE WHEN i % 2 = 0 THEN 'East' ELSE 'South' END AS dir FROM doc_lines)"""


@query("bag_clues", P.with_(LINES) + "SELECT word, clue AS text FROM placed")
def bag_clues(spark, folder):
    return B.clues(puzzles(spark, folder))


def entries(spark, folder):
    """Documents as dictionary records: the sentence list goes to a field by language."""
    sentences = F.split("text", r"\. ")

    def field(lang, value):
        return F.when(F.col("lang") == lang, value)

    return documents(spark, folder).select(
        F.substring_index("text", " ", 1).alias("word"),
        field("en", sentences).alias("definitions"),
        field("fr", sentences).alias("examples"),
        field("de", sentences).alias("equivalents"),
        field("es", sentences).alias("associated"),
        F.when(F.col("lang").isin("es", "en"), F.array("source", "lang")).alias("other"),
    )


SENTENCES = """sentences AS (
  SELECT lang, source, split_part(text, ' ', 1) AS word, string_split(text, '. ') AS parts FROM documents)"""


@query(
    "bag_items",
    P.with_(SENTENCES)
    + """SELECT CASE lang WHEN 'en' THEN 'definitions' WHEN 'fr' THEN 'examples'
               WHEN 'de' THEN 'equivalents' ELSE 'associated' END AS category, word, unnest(parts) AS text
         FROM sentences
         UNION ALL SELECT 'associated', word, unnest([source, lang]) FROM sentences
         WHERE lang IN ('es', 'en')""",
)
def bag_items(spark, folder):
    records = entries(spark, folder)
    fields = ("definitions", "examples", "equivalents")
    bags = {name: B.items(records, name) for name in fields}
    bags["associated"] = B.associated(records)
    return B.union_bags(bags)


@query(
    "bag_clean",
    P.with_(LINES)
    + f"""SELECT words, defs FROM (
            SELECT replace({P.norm('word')}, ' ', ',') AS words, replace({P.norm('clue')}, ' ', ',') AS defs
            FROM placed) WHERE words <> '' AND defs <> ''""",
)
def bag_clean(spark, folder):
    bag = B.clean(B.clues(puzzles(spark, folder)))
    return bag.select(F.array_join("words", ",").alias("words"), F.array_join("defs", ",").alias("defs"))


@query(
    "bag_text_v1",
    P.with_(P.CHAT_PAGES, P.BAGS)
    + """SELECT category, array_to_string(words, ',') AS words, array_to_string(defs, ',') AS defs
         FROM clean_bags""",
)
def bag_text_v1(spark, folder):
    path = fresh_path(spark, "bags-v1")
    bag_text.write_v1(V.clean_bags(V.chat_page_text(spark, folder)), path)
    return bag_text.read_v1(spark, path).select(
        "category", F.array_join("words", ",").alias("words"), F.array_join("defs", ",").alias("defs")
    )


@query(
    "bag_text_v2",
    P.with_(*CHAT)
    + """SELECT category,
           string_agg(form, ',' ORDER BY pos) FILTER (side = 'w') AS words,
           string_agg(stem, ',' ORDER BY pos) FILTER (side = 'w') AS words_stem,
           string_agg(form, ',' ORDER BY pos) FILTER (side = 'd') AS defs,
           string_agg(stem, ',' ORDER BY pos) FILTER (side = 'd') AS defs_stem
         FROM long_stems GROUP BY category, src_id, win""",
)
def bag_text_v2(spark, folder):
    path = fresh_path(spark, "bags-v2")
    bag_text.write_v2(V.stemmed_bags(V.chat_page_text(spark, folder)), path)
    fields = [F.array_join(f, ",").alias(f) for f in bag_text.V2_FIELDS]
    return bag_text.read_v2(spark, path).select("category", *fields)


@query(
    "typed_projection",
    """SELECT doc_id, trim(lang) AS lang, coalesce(quality, 0) AS quality,
              coalesce(toxic, 0)::DOUBLE AS toxic, 0::BIGINT AS source
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def typed_projection(spark, folder):
    rows = V.table(spark, folder, "documents").select("doc_id", "lang", "source").join(
        V.table(spark, folder, "labels"), "doc_id", "left"
    )
    kinds = {"doc_id": "bigint", "lang": "string", "quality": "int", "toxic": "double", "source": "bigint"}
    return Z.typed(rows, kinds)


@query("table_scan_filter", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 7")
def table_scan_filter(spark, folder):
    return V.table(spark, folder, "part").where("p_partkey > 7").select("p_partkey", "p_name")


@query(
    "normalise_items",
    P.with_(LINES)
    + """, ids AS (SELECT row_number() OVER (ORDER BY word) - 1 AS wid, word
                   FROM (SELECT DISTINCT word FROM placed))
         SELECT cwid, wid, x, y, clue, dir FROM placed JOIN ids USING (word)""",
)
def normalise_items(spark, folder):
    records = puzzles(spark, folder)
    dictionary = D.build(B.clues(records))
    return Z.normalise(records, dictionary)["items"].select("cwid", "wid", "x", "y", "clue", "dir")


@query(
    "name_forms",
    r"""SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS answer,
               trim(regexp_replace(p_name || ' #' || p_size || '!', '[^A-Za-z0-9 ]', '', 'g')) AS file_name,
               unnest(string_split(p_type, ' ')) AS part, p_type AS whole FROM part""",
)
def name_forms(spark, folder):
    """Puzzle answers, safe file names and split sequences of part names."""
    titled = F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string"), F.lit("!"))
    return V.table(spark, folder, "part").select(
        "p_partkey", T.puzzle_word(F.col("p_name")).alias("answer"), T.safe_name(titled).alias("file_name"),
        F.explode(F.split("p_type", " ")).alias("part"), F.col("p_type").alias("whole"),
    )


@query(
    "vector_steps",
    """SELECT l_orderkey, l_linenumber, ax * ux + ay * uy AS dot, ax * uy - ay * ux AS det, abs(ax) + abs(ay) AS length,
              CASE t WHEN 0 THEN ax WHEN 1 THEN -ay WHEN 2 THEN -ax ELSE ay END AS turned_x,
              CASE t WHEN 0 THEN ay WHEN 1 THEN ax WHEN 2 THEN -ay ELSE -ax END AS turned_y
       FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 15 - 7 AS INTEGER) AS ax, CAST(l_suppkey % 11 - 5 AS INTEGER) AS ay,
                    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE -1 END AS ux,
                    CASE l_returnflag WHEN 'N' THEN 1 ELSE 0 END AS uy, l_linenumber % 4 AS t FROM lineitem)""",
)
def vector_steps(spark, folder):
    """Places as vectors: products with a unit step, length and quarter turns."""
    flag = F.col("l_returnflag")
    way = F.when(flag == "A", "East").when(flag == "N", "South").otherwise("West")
    ax, ay = (F.col("l_partkey") % 15 - 7).cast("int"), (F.col("l_suppkey") % 11 - 5).cast("int")
    bx, by = R.step_x(way), R.step_y(way)
    x, y = R.turned(ax, ay, F.col("l_linenumber") % 4)
    return V.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", R.dot(ax, ay, bx, by).alias("dot"), R.det(ax, ay, bx, by).alias("det"),
        R.taxicab(ax, ay).alias("length"), x.alias("turned_x"), y.alias("turned_y"),
    )
