"""Shared DuckDB fragments for the oracle strings.

Each constant is one common table expression (``name AS (...)``); ``with_(...)``
strings them together in the order given.  The definitions restate the stand-in
tables of :mod:`clueweave.plans.standins` in plain SQL.
"""


def escapes(col: str) -> str:
    """Upper-case ``col`` and apply the eight replacements in their fixed order."""
    out = f"upper(replace({col}, 'ß', 'ss'))"
    for old, new in (
        ("’", "''"),
        ("Æ", "AE"),
        ("Œ", "OE"),
        ("''LL", "''WILL"),
        ("CAN''T", "CAN NOT"),
        ("N''T", " NOT"),
        ("''D", " HAD"),
        ("''S", ""),
    ):
        out = f"replace({out}, '{old}', '{new}')"
    return out


def ascii_fold(col: str) -> str:
    return f"regexp_replace(strip_accents({escapes(col)}), '[^\\x00-\\x7F]', '', 'g')"


def norm(col: str) -> str:
    return f"trim(regexp_replace({ascii_fold(col)}, '[^A-Z0-9]+', ' ', 'g'))"


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


BAG_TEXT = """bag_text AS (
  SELECT CASE lang WHEN 'en' THEN 'clues' WHEN 'fr' THEN 'definitions'
              WHEN 'de' THEN 'examples' ELSE 'equivalents' END AS category,
         doc_id AS src_id, text FROM documents
  UNION ALL SELECT 'associated', item_id, text FROM benchmark)"""

CHAT_TEXT = """bag_text AS (
  SELECT CASE WHEN role = 'user' THEN 'clues' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'definitions'
              WHEN role = 'assistant' THEN 'associated' ELSE 'examples' END AS category,
         concat_ws(':', conv_id, turn) AS src_id, text FROM conversations
  UNION ALL SELECT 'equivalents', CAST(item_id AS VARCHAR), text FROM benchmark)"""

_VISIBLE = r"""regexp_replace(regexp_replace(html,
           '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'),
           '&#?[A-Za-z0-9]+;', ' ', 'g')"""

#: conversation turns by role, benchmark items and the visible text of whole pages
CHAT_PAGES = f"""bag_text AS (
  SELECT CASE role WHEN 'user' THEN 'clues' WHEN 'assistant' THEN 'definitions' ELSE 'examples' END AS category,
         concat_ws(':', conv_id, turn) AS src_id, text FROM conversations
  UNION ALL SELECT 'equivalents', CAST(item_id AS VARCHAR), text FROM benchmark
  UNION ALL SELECT 'associated', CAST(page_id AS VARCHAR), {_VISIBLE} FROM pages)"""

#: visible text of whole pages: scripts, styles, comments, tags and references become blanks
PAGE_TEXT = r"""bag_text AS (
  SELECT CASE regexp_extract(html, '<html lang="([^"]*)"', 1) WHEN 'en' THEN 'clues' WHEN 'fr' THEN 'definitions'
              WHEN 'de' THEN 'examples' ELSE 'equivalents' END AS category,
         page_id AS src_id,
         regexp_replace(regexp_replace(html,
           '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'),
           '&#?[A-Za-z0-9]+;', ' ', 'g') AS text FROM pages)"""

#: tumbling entries of eight tokens: two headwords, then up to six definition tokens
BAGS = f"""bag_tokens AS (
  SELECT category, src_id, string_split(ntext, ' ') AS toks
  FROM (SELECT category, src_id, {norm('text')} AS ntext FROM bag_text) WHERE ntext <> ''),
bags AS (
  SELECT category, src_id, win, toks[8*win+1:8*win+2] AS words, toks[8*win+3:8*win+8] AS defs
  FROM (SELECT category, src_id, toks, unnest(range(0, (len(toks) + 7) // 8)) AS win
        FROM bag_tokens)),
clean_bags AS (SELECT * FROM bags WHERE len(words) > 0 AND len(defs) > 0)"""

WEIGHTS_V1 = """weights AS (
  SELECT * FROM (VALUES ('clues', 10), ('definitions', 6), ('examples', 6),
                        ('equivalents', 4), ('associated', 1)) AS t(category, tenths))"""

WEIGHTS_V2 = """weights AS (
  SELECT * FROM (VALUES ('clues', 4), ('definitions', 5), ('examples', 1),
                        ('equivalents', 10), ('associated', 6)) AS t(category, tenths))"""

EDGES_V1 = """edges AS (
  SELECT w.word AS src, d.def AS dst, CAST(tenths AS BIGINT) AS tenths
  FROM clean_bags JOIN weights USING (category), unnest(words) AS w(word), unnest(defs) AS d(def))"""

DICTIONARY = """dictionary AS (
  SELECT row_number() OVER (ORDER BY word) - 1 AS wid, word
  FROM (SELECT src AS word FROM edges UNION SELECT dst FROM edges))"""

SUMMED = """summed AS (
  SELECT src, dst, CAST(sum(tenths) AS BIGINT) AS w FROM edges GROUP BY src, dst),
row_max AS (SELECT src, max(w) AS m FROM summed GROUP BY src)"""

#: combined and normalised graph, weight in millionths
GRAPH_V1 = """graph AS (
  SELECT src, dst, CAST(1000000 * w // m AS BIGINT) AS micro
  FROM summed JOIN row_max USING (src) WHERE 10 * w >= m)"""

V1 = (BAG_TEXT, BAGS, WEIGHTS_V1, EDGES_V1)
V1_GRAPH = (*V1, SUMMED, GRAPH_V1)

STEMS = """vocab AS (SELECT DISTINCT unnest(toks) AS form FROM bag_tokens),
stem_pairs AS (
  SELECT v.form, left(v.form, length(v.form) - length(s.suffix)) AS stem
  FROM vocab v, (VALUES ('S'), ('ED'), ('ING'), ('ER'), ('LY')) AS s(suffix)
  WHERE ends_with(v.form, s.suffix) AND length(v.form) - length(s.suffix) >= 2),
stems AS (SELECT p.form, p.stem FROM stem_pairs p JOIN vocab b ON b.form = p.stem),
reduced AS (
  SELECT form, arg_min(stem, (length(stem), stem)) AS stem FROM stems
  WHERE stem NOT IN ('AM', 'IS', 'AR', 'A') GROUP BY form)"""
