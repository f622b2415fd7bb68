"""Dictionary entries from wiki pages, as flat line tables.

A page is cut at its headings with two nested splits of its own text, so sections need no
window and no shuffle; terms and texts are grouped only at the end, one page per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueweave.operators.unnest import each_placed, each_struct

LANGUAGE = "English"
MACRO = r"\{\{.*?\}\}"
LINK = r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"
LABELLED_LINK = r"\[\[[^\[\]|]+\|([^\[\]]+)\]\]"
PLAIN_LINK = r"\[\[([^\[\]|]+)\]\]"
SPELLING = r"\{\{alternative spelling of\|([^|{}]*)\}\}"
TRANSLATION = r"\{\{trans-top\|([^|{}]*)"
DEFINITION_LINE = r"^#{1,2} *[^#:* ]|^[^#*:;={\s]"
EXAMPLE_LINE = "^#+[:*]"


def lines(pages: DataFrame) -> DataFrame:
    """``(page_id, word, lang_no, language, sec_no, level, section, line_no, line)``.

    Level-2 headings open a language, deeper ones a section; a language's own lines form
    section 0.  Blank lines and the heading lines themselves are left out.
    """
    by_language = F.split(F.concat(F.lit("\n"), "text"), "\n(?===[^=])")
    languages = each_placed(pages, by_language, "lang_no", "chunk", "page_id", "word")
    language = F.trim(F.regexp_extract("chunk", "^==([^=]+)==", 1)).alias("language")
    keys = ["page_id", "word", "lang_no"]
    sections = each_placed(
        languages, F.split("chunk", "\n(?====)"), "sec_no", "part", *keys, language
    )
    heading = [
        F.length(F.regexp_extract("part", "^(=*)", 1)).alias("level"),
        F.trim(F.regexp_extract("part", "^=+([^=]+)=+", 1)).alias("section"),
    ]
    split = each_placed(
        sections, F.split("part", "\n"), "line_no", "line", *keys, "language", "sec_no", *heading
    )
    return split.where("line_no > 0 AND trim(line) <> ''")


def letters_only(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z]", "")


def _any_of(title: Column, *needles: str) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(title, F.lit(needle))
    return out


def is_equivalent(title: Column) -> Column:
    """Abbreviations, alternative forms and spellings, symbols."""
    t = letters_only(title)
    return _any_of(t, "abbreviation", "symbol") | (_any_of(t, "alternat") & _any_of(t, "form", "spell"))


def is_associated(title: Column) -> Column:
    """Synonyms and the other -nyms, related and derived terms, etymology and the like."""
    t = letters_only(title)
    return (
        (_any_of(t, "ym") & _any_of(t, "hyper", "hypo", "holo", "sy", "anto", "acro", "paro"))
        | (_any_of(t, "rel") & _any_of(t, "term", "form", "char"))
        | (_any_of(t, "der") & _any_of(t, "ed"))
        | (t == "seealso")
        | _any_of(t, "homo", "anagram")
        | (_any_of(t, "et") & _any_of(t, "gy"))
    )


def is_category(title: Column) -> Column:
    """Parts of speech."""
    t = letters_only(title)
    return _any_of(t, "adjectiv", "verb", "parti", "noun") | (_any_of(t, "pre") & _any_of(t, "sition"))


def clean_reference(link: Column) -> Column:
    """Page name of a link: no urls, namespaces or anchors."""
    named = F.when(F.contains(link, F.lit("//")), F.lit("")).otherwise(F.substring_index(link, ":", -1))
    return F.substring_index(named, "#", 1)


def link_text(text: Column) -> Column:
    """Links replaced by what a reader sees: the label, or the target when there is none."""
    return F.regexp_replace(F.regexp_replace(text, PLAIN_LINK, "$1"), LABELLED_LINK, "$1")


def raw_text(text: Column) -> Column:
    """Text without macros, links replaced by their target."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, MACRO, ""), LINK, "$1"))


def _english(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("language") == LANGUAGE)


_PLACE = ["page_id", "word", "lang_no", "sec_no", "line_no"]


def _entry(kind: Column | str, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"))


def _filled(*arrays: Column) -> Column:
    """The entries of all arrays whose text is not empty; a null array has none."""
    return F.filter(F.flatten(F.array_compact(F.array(*arrays))), lambda e: e["text"] != "")


def _definition_entries() -> Column:
    line = F.col("line")
    own = is_category(F.col("section")) & F.rlike(line, F.lit(DEFINITION_LINE))
    listed = F.when(own, F.array(_entry("definitions", raw_text(F.regexp_replace(line, "^#+", "")))))
    gloss = F.array(_entry("definitions", F.trim(F.regexp_extract(line, TRANSLATION, 1))))
    return _filled(listed, F.when(F.rlike(line, F.lit(TRANSLATION)), gloss))


def _example_entries() -> Column:
    own = is_category(F.col("section")) & F.rlike("line", F.lit(EXAMPLE_LINE))
    return _filled(F.when(own, F.array(_entry("examples", raw_text(F.regexp_replace("line", "^[#:*]+", ""))))))


def _reference_entries() -> Column:
    kind = (
        F.when(is_equivalent(F.col("section")), "equivalents")
        .when(is_associated(F.col("section")), "associated")
        .otherwise("other")
    )
    links = F.transform(
        F.regexp_extract_all("line", F.lit(LINK), F.lit(1)), lambda link: _entry(kind, clean_reference(link))
    )
    spellings = F.transform(
        F.regexp_extract_all("line", F.lit(SPELLING), F.lit(1)), lambda term: _entry("spelling", term)
    )
    return _filled(links, F.when(is_category(F.col("section")), spellings))


def definitions(rows: DataFrame) -> DataFrame:
    """Paragraphs and list lines up to depth two of part-of-speech sections, and translation glosses."""
    return each_struct(_english(rows), _definition_entries(), "text", *_PLACE).drop("kind")


def examples(rows: DataFrame) -> DataFrame:
    """Usage and quotation lines of part-of-speech sections."""
    return each_struct(_english(rows), _example_entries(), "text", *_PLACE).drop("kind")


def references(rows: DataFrame) -> DataFrame:
    """``(page_id, word, kind, term)``: distinct link targets and spellings by section class."""
    found = each_struct(_english(rows), _reference_entries(), "text", "page_id", "word")
    return found.withColumnRenamed("text", "term").distinct()


def partition_terms(found: DataFrame) -> DataFrame:
    """Each term in its strongest class: equivalents before associated before other.

    A word is not its own related term; explicit spelling macros are exempt, as they name
    the word they belong to.  The smallest rank per term replaces a chain of anti-joins.
    """
    kinds = F.col("kind")
    rank = F.when(kinds.isin("equivalents", "spelling"), 0).when(kinds == "associated", 1).otherwise(2)
    foreign = found.where((F.lower("term") != F.lower("word")) | (kinds == "spelling"))
    best = foreign.groupBy("page_id", "word", "term").agg(F.min(rank).alias("rank"))
    names = F.array(F.lit("equivalents"), F.lit("associated"), F.lit("other"))
    return best.select("page_id", "word", F.get(names, F.col("rank")).alias("kind"), "term")


def records(rows: DataFrame) -> DataFrame:
    """One record per page and word; empty lists are null (and absent from JSON).

    Every line gives all its entries at once, so the pages are read once and grouped once.  A
    record gathers what one page holds, so it is never larger than its page; its terms are put
    into their strongest class inside the record.
    """
    everything = F.concat(_definition_entries(), _example_entries(), _reference_entries())
    entries = each_struct(_english(rows), everything, "text", *_PLACE)
    foreign = (F.lower("text") != F.lower("word")) | ~F.col("kind").isin("equivalents", "associated", "other")
    kind = F.when(F.col("kind") == "spelling", "equivalents").otherwise(F.col("kind"))

    def gathered(name):
        return F.collect_list(F.when(kind == name, F.struct("sec_no", "line_no", "text"))).alias(name)

    kinds = ("equivalents", "associated", "other", "definitions", "examples")
    pages = entries.where(foreign).groupBy("page_id", "word").agg(*[gathered(k) for k in kinds])
    terms = {k: F.array_distinct(F.col(k)["text"]) for k in kinds[:3]}
    weaker = F.array_except(terms["associated"], terms["equivalents"])
    lists = {
        "equivalents": F.array_sort(terms["equivalents"]),
        "associated": F.array_sort(weaker),
        "other": F.array_sort(F.array_except(F.array_except(terms["other"], terms["equivalents"]), weaker)),
        **{k: F.array_sort(k)["text"] for k in kinds[3:]},
    }
    return pages.select("page_id", "word", *[F.when(F.size(v) > 0, v).alias(k) for k, v in lists.items()])
