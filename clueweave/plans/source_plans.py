"""File formats: rows of the given tables are written in a format, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from clueweave.operators import bags as B
from clueweave.operators import dictionary as D
from clueweave.operators import stems as S
from clueweave.plans import sqlparts as P
from clueweave.plans import standins as V
from clueweave.plans.registry import query
from clueweave.session import fresh_path, spread
from clueweave.sources import bag_text, matrix, ranges, records, store


def text_entries(spark, folder):
    """Documents as dictionary entries: paragraphs as definitions, language as related word."""
    return spread(V.table(spark, folder, "documents")).select(
        F.concat("source", F.lit("/"), "doc_id").alias("word"),
        F.split("text", "\n").alias("definitions"),
        F.when(F.col("lang") != "en", F.array("lang")).alias("associated"),
    )


ENTRIES = """SELECT source || '/' || doc_id AS word, unnest(string_split(text, chr(10))) AS definition,
                    CASE WHEN lang <> 'en' THEN lang END AS associated FROM documents"""


def opened(entries):
    return entries.select(
        "word", F.explode("definitions").alias("definition"), F.get("associated", F.lit(0)).alias("associated")
    )


@query("json_roundtrip", ENTRIES)
def json_roundtrip(spark, folder):
    """Entries as compressed JSON lines, a bounded number to a file."""
    path = fresh_path(spark, "entries")
    records.write_json(text_entries(spark, folder), path)
    return opened(records.read_lines(spark, path, records.ENTRY))


@query("json_arrays", ENTRIES)
def json_arrays(spark, folder):
    """Entries as array files bounded in records and bytes, read as whole documents."""
    path = fresh_path(spark, "entry-arrays")
    records.write_arrays(text_entries(spark, folder), path)
    return opened(records.read_entries(spark, path, pattern="*.txt*"))


@query("json_nested_arrays", ENTRIES)
def json_nested_arrays(spark, folder):
    """The same with arrays in arrays, none to five levels deeper."""
    path = fresh_path(spark, "entry-nests")
    records.write_arrays(text_entries(spark, folder), path, max_bytes=4 << 20, nested=5)
    return opened(records.read_nested_entries(spark, path))


@query("json_split_scan", ENTRIES)
def json_split_scan(spark, folder):
    """Large array files of mixed depth, read in byte ranges by as many tasks."""
    path = fresh_path(spark, "entry-ranges")
    records.write_arrays(text_entries(spark, folder), path, per_file=1 << 30, nested=3, codec="none")
    return opened(ranges.read_json_records(spark, path, records.ENTRY, range_bytes=1 << 20))


STORE = """puzzle AS (SELECT doc_id, source, lang, text, doc_id::VARCHAR AS url, doc_id % 3 = 0 AS late FROM documents),
  lines AS (SELECT doc_id, url, late, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS i FROM puzzle),
  placed AS (SELECT doc_id, late, split_part(line, ' ', 1) AS word, regexp_replace(line, '^[^ ]* ?', '') AS clue,
                    CAST(i % 15 AS INTEGER) AS x, CAST(i // 15 AS INTEGER) AS y,
                    CASE WHEN i % 2 = 0 THEN 'East' ELSE 'South' END AS dir FROM lines),
  puzzle_ids AS (SELECT doc_id, row_number() OVER (ORDER BY late, url) - 1 AS cwid FROM puzzle),
  word_ids AS (SELECT word, row_number() OVER (ORDER BY late, word) - 1 AS wid
               FROM (SELECT word, bool_and(late) AS late FROM placed GROUP BY word))"""


def store_of_documents(spark, folder):
    """Documents in two batches that share a third of the rows; the second also repeats some."""
    docs = spread(V.table(spark, folder, "documents"))
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
    nothing = F.lit(None).cast("string")
    puzzles = docs.select(
        "source", F.col("lang").alias("language"), nothing.alias("title"), F.col("doc_id").cast("string").alias("url"),
        nothing.alias("date"), nothing.alias("author"), F.array("lang", "source", F.lit("")).alias("categories"),
        lines.alias("words"),
    )
    third = F.col("url").cast("bigint") % 3
    path = fresh_path(spark, "growing")
    store.append(spark, path, puzzles.where(third != 0), key=("url",))
    second = puzzles.where(third != 1)
    store.append(spark, path, second.union(second.where(F.col("url").cast("bigint") % 5 == 0)), key=("url",))
    return store.load(spark, path)


@query(
    "store_items",
    f"""WITH {STORE} SELECT DISTINCT cwid, wid, word, x, y, clue, dir
        FROM placed JOIN puzzle_ids USING (doc_id) JOIN word_ids USING (word)""",
)
def store_items(spark, folder):
    """Items and words of a store that grew in two batches."""
    tables = store_of_documents(spark, folder)
    return tables["items"].join(tables["words"], "wid").select("cwid", "wid", "word", "x", "y", "clue", "dir")


@query(
    "store_puzzles",
    f"""WITH {STORE} SELECT DISTINCT cwid, url, source, lang AS language, unnest([lang, source]) AS category
        FROM puzzle JOIN puzzle_ids USING (doc_id)""",
)
def store_puzzles(spark, folder):
    """Puzzles and categories of the same store."""
    tables = store_of_documents(spark, folder)
    return tables["puzzles"].join(tables["categories"], "cwid").select("cwid", "url", "source", "language", "category")


PLACES = """SELECT l_partkey AS wid_from, l_suppkey AS wid_to, sum(l_quantity)::DOUBLE AS weight
            FROM lineitem GROUP BY ALL"""


@query(
    "matrix_csv_load",
    f"""SELECT wid_from, wid_to, weight, p_name AS word FROM ({PLACES}) JOIN part ON p_partkey = wid_from""",
)
def matrix_csv_load(spark, folder):
    """Adjacency and index files, loaded into the store and joined from there."""
    adjacency = (
        V.table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").alias("wid_from"), F.col("l_suppkey").alias("wid_to"))
        .agg(F.sum("l_quantity").cast("double").alias("weight"))
    )
    index = V.table(spark, folder, "part").select(F.col("p_partkey").alias("wid"), F.col("p_name").alias("word"))
    places, names, store = (fresh_path(spark, n) for n in ("adjacency", "index", "store"))
    matrix.write_adjacency(adjacency, places)
    matrix.write_index(index, names)
    records.store_tables(
        {"neighbors": matrix.read_adjacency(spark, places), "words": matrix.read_index(spark, names)}, store
    )
    loaded = records.load_tables(spark, store, ["neighbors", "words"])
    words = loaded["words"].withColumnRenamed("wid", "wid_from")
    return loaded["neighbors"].join(words, "wid_from").select("wid_from", "wid_to", "weight", "word")


@query(
    "stem_index_file",
    P.with_(P.CHAT_PAGES, P.BAGS, P.STEMS)
    + "SELECT coalesce(r.stem, v.form) AS stem, v.form FROM vocab v LEFT JOIN reduced r USING (form)",
)
def stem_index_file(spark, folder):
    path = fresh_path(spark, "stem-index")
    vocabulary = V.vocabulary(V.chat_page_text(spark, folder))
    bag_text.write_stem_index(S.stem_index(vocabulary, S.derive_stems(vocabulary)), path)
    return bag_text.read_stem_index(spark, path)


@query(
    "sparse_text_parse",
    """SELECT i, j, sum(v) AS v FROM (
         SELECT vec_id + 1 AS i, CAST(unnest(range(len(embedding))) // 2 + 1 AS BIGINT) AS j,
                unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY i, j""",
)
def sparse_text_parse(spark, folder):
    """Vectors as printed sparse rows; every two neighbours share an index and add up."""
    path = fresh_path(spark, "sparse")
    cells = F.transform("embedding", lambda v: v.cast("double"))
    places = F.transform("embedding", lambda v, i: F.floor(i / 2) + 1)
    line = F.concat(
        F.lit("("), F.col("vec_id") + 1,
        F.lit(",["), F.array_join(places.cast("array<string>"), ","),
        F.lit("],["), F.array_join(cells.cast("array<string>"), ","), F.lit("])"),
    )
    V.table(spark, folder, "embeddings").select(line.alias("value")).write.text(path, compression="bzip2")
    return matrix.parse_sparse(spark.read.text(path))


@query(
    "reduced_text_parse",
    P.with_(P.BAG_TEXT, P.BAGS, P.WEIGHTS_V1)
    + """SELECT array_to_string(words, ' ') AS words, array_to_string(defs, ' ') AS defs,
                tenths / 10.0::DOUBLE AS weight FROM clean_bags JOIN weights USING (category)""",
)
def reduced_text_parse(spark, folder):
    """Weighted bags as printed tuples."""
    path = fresh_path(spark, "reduced")
    bags = B.weigh(V.clean_bags(V.document_text(spark, folder)))
    listed = lambda c: F.concat(F.lit("List("), F.array_join(c, ", "), F.lit(")"))
    weight = (F.col("tenths") / 10.0).cast("string")
    line = F.concat(F.lit("("), listed("words"), F.lit(","), listed("defs"), F.lit(","), weight, F.lit(")"))
    bags.select(line.alias("value")).write.text(path, compression="bzip2")
    return matrix.parse_reduced(spark.read.text(path)).select(
        F.array_join("words", " ").alias("words"), F.array_join("defs", " ").alias("defs"), "weight"
    )


@query("xml_pages", "SELECT url AS title, trim(html, chr(10) || ' ') AS text FROM pages WHERE page_id % 3 <> 1")
def xml_pages(spark, folder):
    """Pages as an XML dump with two namespaces, of which the main one is read."""
    path = fresh_path(spark, "dump")
    page = V.table(spark, folder, "pages").select(
        F.col("url").alias("title"),
        (F.col("page_id") % 3 == 1).cast("int").alias("ns"),
        F.struct(F.trim("html", F.lit("\n ")).alias("text")).alias("revision"),
    )
    page.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return records.read_pages(spark, path)


@query("xml_split_pages", "SELECT url AS title, html AS text FROM pages WHERE page_id % 3 <> 1")
def xml_split_pages(spark, folder):
    """The same kind of dump as compressed text, split inside its files."""
    path = fresh_path(spark, "split-dump")
    escaped = F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit("  <page>\n    <title>"), F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit("</title>\n    <ns>"), (F.col("page_id") % 3 == 1).cast("int"),
        F.lit('</ns>\n    <revision><text xml:space="preserve">'), escaped,
        F.lit("</text></revision>\n  </page>"),
    )
    V.table(spark, folder, "pages").select(page.alias("value")).write.text(path, compression="bzip2")
    return ranges.read_split_pages(spark, path)


@query(
    "stored_dictionary",
    P.with_(*P.V1, P.DICTIONARY) + "SELECT wid, word FROM dictionary",
)
def stored_dictionary(spark, folder):
    """The dictionary written as an index file and read back."""
    path = fresh_path(spark, "dictionary")
    matrix.write_index(D.build(D.vocabulary(V.edges_v1(V.document_text(spark, folder)))), path)
    return matrix.read_index(spark, path)
