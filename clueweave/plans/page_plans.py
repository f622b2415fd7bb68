"""Page and dictionary extraction queries over the web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from clueweave.functions.directions import parse_direction
from clueweave.operators import pages as H
from clueweave.operators import wiki as W
from clueweave.operators.unnest import each_struct
from clueweave.plans import standins as V
from clueweave.plans.registry import query
from clueweave.session import fresh_path, spread

ITEM = '<li><a href="/([^"]*)">([^<]*)</a></li>'
PARAGRAPH = "<p>([^<]*)"
FIELDS = {
    "title": "<title>([^<]*)</title>",
    "language": '<html lang="([^"]*)"',
    "heading": "<h1>([^<]*)</h1>",
    "author": '<li class="byline">([^<]*)</li>',
    "footer": r"<footer>&copy; ([^<& ]*)",
}


def pages(spark, folder):
    return spread(V.table(spark, folder, "pages"))


@query(
    "html_fields",
    "SELECT page_id, "
    + ", ".join(
        f"CASE WHEN regexp_matches(html, '{p}') THEN regexp_extract(html, '{p}', 1) END AS {n}"
        for n, p in FIELDS.items()
    )
    + " FROM pages",
)
def html_fields(spark, folder):
    return H.fields(pages(spark, folder), FIELDS)


LISTED = f"""hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, '{ITEM}', 1)) AS href,
    unnest(regexp_extract_all(html, '{ITEM}', 2)) AS label,
    CAST(unnest(range(len(regexp_extract_all(html, '{ITEM}', 1)))) AS INTEGER) AS pos FROM pages),
paras AS (SELECT page_id, unnest(regexp_extract_all(html, '{PARAGRAPH}', 1)) AS para,
    CAST(unnest(range(len(regexp_extract_all(html, '{PARAGRAPH}', 1)))) AS INTEGER) AS pos FROM pages)"""


@query("html_repeated", f"WITH {LISTED} SELECT page_id, pos, href, label FROM hrefs")
def html_repeated(spark, folder):
    return H.repeated(pages(spark, folder), ITEM, "href", "label")


ANCHOR = '<a href="([^"]*)">([^<]*)</a>'


@query(
    "html_links",
    f"""SELECT page_id, regexp_extract(url, '^https?://[^/]*', 0)
                 || unnest(regexp_extract_all(html, '{ANCHOR}', 1)) AS link,
               unnest(regexp_extract_all(html, '{ANCHOR}', 2)) AS label FROM pages""",
)
def html_links(spark, folder):
    site = F.regexp_extract("url", "^https?://[^/]*", 0)
    found = each_struct(
        pages(spark, folder), H.matches(F.col("html"), ANCHOR, "href", "label"), "href", "page_id", site.alias("site")
    )
    return found.select("page_id", F.concat("site", "href").alias("link"), "label")


@query(
    "html_zip_join",
    f"""WITH {LISTED}, sizes AS (
          SELECT page_id, CASE regexp_extract(html, '<html lang="([^"]*)"', 1)
            WHEN 'en' THEN 12 WHEN 'fr' THEN 14 WHEN 'de' THEN 16 ELSE 18 END AS n FROM pages)
        SELECT h.page_id, h.pos % n AS x, h.pos // n AS y, label, coalesce(para, '?') AS para
        FROM hrefs h JOIN sizes s ON s.page_id = h.page_id
        LEFT JOIN paras p ON p.page_id = h.page_id AND p.pos = h.pos""",
)
def html_zip_join(spark, folder):
    """Two lists of a page paired by place; the grid size follows from the page's class."""
    html = F.col("html")
    lang = H.first_match(html, FIELDS["language"])
    size = F.when(lang == "en", 12).when(lang == "fr", 14).when(lang == "de", 16).otherwise(18)
    labels = F.regexp_extract_all(html, F.lit(ITEM), F.lit(2))
    paras = F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1))
    paired = F.transform(
        labels,
        lambda label, i: F.struct(
            (i % F.col("n")).alias("x"),
            F.floor(i / F.col("n")).cast("int").alias("y"),
            label.alias("label"),
            F.coalesce(F.get(F.col("paras"), i), F.lit("?")).alias("para"),
        ),
    )
    rows = pages(spark, folder).withColumns({"n": size, "paras": paras})
    return rows.select("page_id", F.inline(paired))


@query(
    "html_clue_join",
    f"""WITH {LISTED}
        SELECT h.page_id, h.label AS word, trim(para) AS clue, (29 * h.pos + 3) // 29 AS x, h.pos // 5 AS y,
               CASE WHEN h.pos % 2 = 0 THEN 'East' ELSE 'South' END AS dir
        FROM hrefs h JOIN paras p ON p.page_id = h.page_id AND p.pos = h.pos WHERE label <> ''""",
)
def html_clue_join(spark, folder):
    """List items as numbered places, their labels as letters and paragraphs as clues."""
    labels = F.regexp_extract_all("html", F.lit(ITEM), F.lit(2))
    paras = F.regexp_extract_all("html", F.lit(PARAGRAPH), F.lit(1))

    def key(pos):
        side = parse_direction(F.when(pos % 2 == 0, "across").otherwise("down"))
        return (pos + 1).alias("num"), side.alias("dir")

    locations = F.transform(
        labels,
        lambda _, p: F.struct(
            *key(p),
            F.floor((29 * p + 3) / 29).cast("int").alias("x"),
            F.floor(p / 5).cast("int").alias("y"),
        ),
    )
    letters = F.flatten(
        F.transform(
            labels,
            lambda label, p: F.transform(
                F.split(label, ""), lambda c, i: F.struct(*key(p), i.alias("i"), c.alias("letter"))
            ),
        )
    )
    clues = F.transform(paras, lambda text, p: F.struct(*key(p), F.trim(text).alias("clue")))
    return H.join_words(pages(spark, folder), locations, letters, clues)


@query(
    "incremental_new_pages",
    """SELECT page_id, url, CASE WHEN regexp_matches(html, '<h1>[^<]+</h1>') THEN 'new' ELSE 'failed' END AS state
       FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)""",
)
def incremental_new_pages(spark, folder):
    done = V.table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"))
    fresh = H.new_pages(pages(spark, folder), done)
    usable = F.regexp_like("html", F.lit("<h1>[^<]+</h1>"))
    return fresh.select("page_id", "url", F.when(usable, "new").otherwise("failed").alias("state"))


@query(
    "incremental_stream",
    """SELECT page_id, url, CASE WHEN regexp_matches(html, '<h1>[^<]+</h1>') THEN 'new' ELSE 'failed' END AS state,
              CAST(page_id % 3 AS INTEGER) AS batch FROM pages""",
)
def incremental_stream(spark, folder):
    """Three runs of a stream over a growing folder; every delivery repeats the one before."""
    source, store, checkpoint = (fresh_path(spark, n) for n in ("arriving", "taken", "offsets"))
    whole = V.table(spark, folder, "pages")
    usable = F.regexp_like("html", F.lit("<h1>[^<]+</h1>"))
    for run in range(3):
        whole.where((F.col("page_id") % 3).isin(run, run - 1)).write.mode("append").parquet(source)
        H.ingest(spark, source, whole.schema, store, checkpoint, usable)
    return spark.read.parquet(store).select("page_id", "url", "state", "batch")


#: how page markup is turned into wiki markup, in this order (pattern, replacement)
TO_WIKI = (
    ("\n", " "),
    (". ", ".\n#: "),
    ("<nav>", "\n==English==\n===Synonyms==="),
    ('<li><a href="', "\n* [["),
    ("</a></li>", "]]"),
    ('<div class="ad">', "\n====See also====\n* [["),
    ("</div>", "]]"),
    ("<h1>", "\n===Alternative forms===\n* [["),
    ("</h1>", "]]\n===Noun===\n{{trans-top|gloss of the noun}}"),
    ("<p>", "\n# "),
    ("<b>", "\n{{alternative spelling of|"),
    ("<br>", "}}\n#* "),
    ("<footer>", "\n==French==\n===Verb===\n# "),
    ('">', "|"),
)


def wiki_sql() -> str:
    text = "html"
    for old, new in TO_WIKI:
        text = f"replace({text}, e'{_escape(old)}', e'{_escape(new)}')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    label = f"regexp_extract(html, '{ITEM}', 2)"
    return f"wiki AS (SELECT page_id, {label} AS word, {text} AS text FROM pages)"


def _escape(value: str) -> str:
    return value.replace("'", "''").replace("\n", "\\n")


def wiki_pages(spark, folder):
    """Web pages rewritten as wiki text; the first listed label is the page's word."""
    text = F.col("html")
    for old, new in TO_WIKI:
        text = F.replace(text, F.lit(old), F.lit(new))
    return pages(spark, folder).select(
        "page_id",
        F.regexp_extract("html", ITEM, 2).alias("word"),
        F.regexp_replace(text, "<[^>]*>", "").alias("text"),
    )


WIKI_LINES = f"""{wiki_sql()},
ln AS (SELECT page_id, word, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS i FROM wiki),
marked AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^==[^=]') THEN 1 ELSE 0 END)
             OVER (PARTITION BY page_id ORDER BY i) AS lang_no FROM ln),
sectioned AS (SELECT *, sum(CASE WHEN starts_with(line, '===') THEN 1 ELSE 0 END)
             OVER (PARTITION BY page_id, lang_no ORDER BY i) AS sec_no FROM marked),
placed_lines AS (SELECT *, row_number() OVER w - CASE WHEN lang_no = 0 AND sec_no = 0 THEN 0 ELSE 1 END AS line_no,
    CASE WHEN lang_no > 0 OR sec_no > 0 THEN first_value(line) OVER w ELSE '' END AS head,
    CASE WHEN lang_no > 0 THEN first_value(line) OVER v ELSE '' END AS lang_head
  FROM sectioned WINDOW w AS (PARTITION BY page_id, lang_no, sec_no ORDER BY i),
                        v AS (PARTITION BY page_id, lang_no ORDER BY i)),
rows_ AS (SELECT page_id, word, CAST(lang_no AS INTEGER) AS lang_no,
    trim(regexp_extract(lang_head, '^==([^=]+)==', 1)) AS language, CAST(sec_no AS INTEGER) AS sec_no,
    CAST(length(regexp_extract(head, '^(=*)', 1)) AS INTEGER) AS level,
    trim(regexp_extract(head, '^=+([^=]+)=+', 1)) AS section, CAST(line_no AS INTEGER) AS line_no, line
  FROM placed_lines WHERE line_no > 0 AND trim(line) <> '')"""


@query(
    "wiki_sections",
    f"WITH {WIKI_LINES} SELECT page_id, lang_no, language, sec_no, level, section, line_no, line FROM rows_",
)
def wiki_sections(spark, folder):
    return W.lines(wiki_pages(spark, folder)).drop("word")


def class_sql(col: str) -> dict[str, str]:
    t = f"regexp_replace(lower({col}), '[^a-z]', '', 'g')"

    def any_of(*needles):
        return "(" + " OR ".join(f"contains({t}, '{n}')" for n in needles) + ")"

    return {
        "equivalent": f"({any_of('abbreviation', 'symbol')} OR ({any_of('alternat')} AND {any_of('form', 'spell')}))",
        "associated": f"""(({any_of('ym')} AND {any_of('hyper', 'hypo', 'holo', 'sy', 'anto', 'acro', 'paro')})
            OR ({any_of('rel')} AND {any_of('term', 'form', 'char')}) OR ({any_of('der')} AND {any_of('ed')})
            OR {t} = 'seealso' OR {any_of('homo', 'anagram')} OR ({any_of('et')} AND {any_of('gy')}))""",
        "category": f"({any_of('adjectiv', 'verb', 'parti', 'noun')} OR ({any_of('pre')} AND {any_of('sition')}))",
    }


LABEL_CLASS, SECTION_CLASS = class_sql("label"), class_sql("section")


@query(
    "wiki_section_class",
    f"""WITH {LISTED} SELECT page_id, pos, label, {LABEL_CLASS['equivalent']} AS equivalent,
          {LABEL_CLASS['associated']} AS associated, {LABEL_CLASS['category']} AS category FROM hrefs""",
)
def wiki_section_class(spark, folder):
    label = F.col("label")
    return H.repeated(pages(spark, folder), ITEM, "href", "label").select(
        "page_id",
        "pos",
        "label",
        W.is_equivalent(label).alias("equivalent"),
        W.is_associated(label).alias("associated"),
        W.is_category(label).alias("category"),
    )


@query(
    "wiki_reference_clean",
    """WITH links AS (
         SELECT page_id, url AS link FROM pages
         UNION ALL SELECT page_id, replace(url, '//', '/') FROM pages
         UNION ALL SELECT page_id, replace(replace(url, '//', ':'), '?', '#') FROM pages)
       SELECT page_id, link, regexp_extract(
           CASE WHEN contains(link, '//') THEN '' ELSE regexp_replace(link, '^.*:', '') END, '^[^#]*', 0) AS term
       FROM links""",
)
def wiki_reference_clean(spark, folder):
    """Urls as they are, as a path and as namespace:page#anchor."""
    forms = F.array(
        F.col("url"),
        F.replace("url", F.lit("//"), F.lit("/")),
        F.replace(F.replace("url", F.lit("//"), F.lit(":")), F.lit("?"), F.lit("#")),
    )
    links = V.table(spark, folder, "pages").select("page_id", F.explode(forms).alias("link"))
    return links.withColumn("term", W.clean_reference(F.col("link")))


def raw_sql(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace({col}, '{W.MACRO}', '', 'g'), '{W.LINK}', '\\1', 'g'))"


@query(
    "wiki_links_text",
    f"""WITH {wiki_sql()} SELECT page_id,
          regexp_replace(regexp_replace(text, '{W.PLAIN_LINK}', '\\1', 'g'), '{W.LABELLED_LINK}', '\\1', 'g') AS shown,
          {raw_sql('text')} AS raw FROM wiki""",
)
def wiki_links_text(spark, folder):
    text = F.col("text")
    return wiki_pages(spark, folder).select(
        "page_id", W.link_text(text).alias("shown"), W.raw_text(text).alias("raw")
    )


TEXTS = f"""english AS (SELECT * FROM rows_ WHERE language = 'English'),
definitions AS (
  SELECT page_id, word, lang_no, sec_no, line_no, {raw_sql("regexp_replace(line, '^#+', '')")} AS text
  FROM english WHERE {SECTION_CLASS['category']} AND regexp_matches(line, '{W.DEFINITION_LINE}')
  UNION ALL
  SELECT page_id, word, lang_no, sec_no, line_no, trim(regexp_extract(line, '{W.TRANSLATION}', 1))
  FROM english WHERE regexp_matches(line, '{W.TRANSLATION}')),
examples AS (
  SELECT page_id, word, lang_no, sec_no, line_no, {raw_sql("regexp_replace(line, '^[#:*]+', '')")} AS text
  FROM english WHERE {SECTION_CLASS['category']} AND regexp_matches(line, '{W.EXAMPLE_LINE}'))"""

TERMS = f"""links AS (
  SELECT page_id, word, CASE WHEN {SECTION_CLASS['equivalent']} THEN 'equivalents'
           WHEN {SECTION_CLASS['associated']} THEN 'associated' ELSE 'other' END AS kind,
         unnest(regexp_extract_all(line, '{W.LINK}', 1)) AS link FROM english),
refs AS (
  SELECT DISTINCT * FROM (
    SELECT page_id, word, kind, regexp_extract(
      CASE WHEN contains(link, '//') THEN '' ELSE regexp_replace(link, '^.*:', '') END, '^[^#]*', 0) AS term FROM links
    UNION ALL
    SELECT page_id, word, 'spelling', unnest(regexp_extract_all(line, '{W.SPELLING}', 1))
    FROM english WHERE {SECTION_CLASS['category']}) WHERE term <> ''),
equivalents AS (SELECT DISTINCT page_id, word, term FROM refs
  WHERE (kind = 'equivalents' AND lower(term) <> lower(word)) OR kind = 'spelling'),
associated AS (SELECT DISTINCT page_id, word, term FROM refs r
  WHERE kind = 'associated' AND lower(term) <> lower(word)
    AND NOT EXISTS (SELECT 1 FROM equivalents e WHERE e.page_id = r.page_id AND e.term = r.term)),
other AS (SELECT DISTINCT page_id, word, term FROM refs r WHERE lower(term) <> lower(word)
    AND NOT EXISTS (SELECT 1 FROM equivalents e WHERE e.page_id = r.page_id AND e.term = r.term)
    AND NOT EXISTS (SELECT 1 FROM associated a WHERE a.page_id = r.page_id AND a.term = r.term)),
parted AS (SELECT page_id, word, 'equivalents' AS kind, term FROM equivalents
  UNION ALL SELECT page_id, word, 'associated', term FROM associated
  UNION ALL SELECT page_id, word, 'other', term FROM other)"""

WIKI = f"WITH {WIKI_LINES}, {TEXTS} "
WIKI_TERMS = f"WITH {WIKI_LINES}, {TEXTS}, {TERMS} "


@query("wiki_definitions", WIKI + "SELECT page_id, word, sec_no, line_no, text FROM definitions WHERE text <> ''")
def wiki_definitions(spark, folder):
    return W.definitions(W.lines(wiki_pages(spark, folder))).drop("lang_no")


@query("wiki_examples", WIKI + "SELECT page_id, word, sec_no, line_no, text FROM examples WHERE text <> ''")
def wiki_examples(spark, folder):
    return W.examples(W.lines(wiki_pages(spark, folder))).drop("lang_no")


@query("wiki_references", WIKI_TERMS + "SELECT page_id, kind, term FROM refs")
def wiki_references(spark, folder):
    return W.references(W.lines(wiki_pages(spark, folder))).drop("word")


@query("related_terms_partition", WIKI_TERMS + "SELECT page_id, kind, term FROM parted")
def related_terms_partition(spark, folder):
    return W.partition_terms(W.references(W.lines(wiki_pages(spark, folder)))).drop("word")


@query(
    "wiki_entry",
    WIKI_TERMS
    + """, parts AS (
           SELECT page_id, word, kind, 0 AS sec_no, 0 AS line_no, term AS text FROM parted
           UNION ALL SELECT page_id, word, 'definitions', sec_no, line_no, text FROM definitions WHERE text <> ''
           UNION ALL SELECT page_id, word, 'examples', sec_no, line_no, text FROM examples WHERE text <> '')
         SELECT page_id, word, """
    + ", ".join(
        f"string_agg(text, '|' ORDER BY sec_no, line_no, text) FILTER (kind = '{k}') AS {k}"
        for k in ("equivalents", "associated", "other", "definitions", "examples")
    )
    + " FROM parts GROUP BY page_id, word",
)
def wiki_entry(spark, folder):
    kinds = ("equivalents", "associated", "other", "definitions", "examples")
    entries = W.records(W.lines(wiki_pages(spark, folder)))
    return entries.select("page_id", "word", *[F.array_join(k, "|").alias(k) for k in kinds])
