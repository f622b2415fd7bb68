"""Retrieval, feature and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clueweave.functions import text as T
from clueweave.functions import vectors as X
from clueweave.operators import bags as B
from clueweave.operators import classify as C
from clueweave.operators import dictionary as D
from clueweave.operators import graph as G
from clueweave.operators import impact
from clueweave.operators import pca as A
from clueweave.operators import retrieval as I
from clueweave.operators.skew import salted_join
from clueweave.operators.unnest import each_struct
from clueweave.plans import sqlparts as P
from clueweave.plans import standins as V
from clueweave.plans.registry import query
from clueweave.session import spread, written

DOC_TOKENS = f"""doc_tokens AS (
  SELECT doc_id, lang, string_split({P.norm('text')}, ' ') AS toks FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT doc_id, unnest(toks) AS term FROM doc_tokens) WHERE term <> '' GROUP BY doc_id, term),
idf AS (SELECT term, CAST(count(*) AS BIGINT) AS df,
               ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY term),
tfidf AS (SELECT doc_id, term, n * idf AS v FROM tf JOIN idf USING (term)),
lengths AS (SELECT doc_id, sqrt(sum(v * v)) AS length FROM tfidf GROUP BY doc_id)"""

TFIDF = P.with_(DOC_TOKENS)
TOP = 1000

#: query lines a user might type; their words occur in the driver documents
LINES = {
    1: "the pathetic idiot, and that thing!",
    2: "Nicht die Einheit",
    3: "que está la ción",
    4: "worthless scum",
}


def documents(spark, folder):
    return spread(V.table(spark, folder, "documents").select("doc_id", "lang", "text")).select(
        "doc_id", "lang", T.tokens(T.normalize(F.col("text"))).alias("toks")
    )


def term_table(spark, folder):
    """Documents and their counted terms; the counts are read several times, so written."""
    docs = documents(spark, folder)
    return docs, written(I.term_counts(docs), "tf")


def tfidf_table(spark, folder):
    """The weights are stored, so that the join with the counts knows their real size."""
    docs, tf = term_table(spark, folder)
    return I.tfidf(tf, written(I.idf(tf, docs), "idf"))


def rounded(values):
    return values.withColumn("tfidf", F.round("tfidf", 6))


SIZES = """sizes AS MATERIALIZED (SELECT unnest([(SELECT count(DISTINCT term) FROM tf), 1048576, 26]) AS buckets),
placed AS MATERIALIZED (SELECT term, buckets, CAST(('0x' || left(md5(term), 8))::BIGINT % buckets AS BIGINT) AS bucket
           FROM (SELECT DISTINCT term FROM tf), sizes)"""


def hash_sizes(spark, counted):
    """A bucket per term on average, a size that keeps nearly all apart, and one for letters."""
    terms = counted.agg(F.count_distinct("term").alias("buckets"))
    return terms.union(spark.createDataFrame([(1 << 20,), (26,)], "buckets bigint"))


@query(
    "hashed_tf",
    P.with_(DOC_TOKENS, SIZES)
    + """SELECT doc_id, buckets, bucket, CAST(sum(n) AS BIGINT) AS n
         FROM tf JOIN placed USING (term) GROUP BY doc_id, buckets, bucket""",
)
def hashed_tf(spark, folder):
    _, counted = term_table(spark, folder)
    return I.hashed_counts(counted, hash_sizes(spark, counted))


@query(
    "hash_collisions",
    P.with_(DOC_TOKENS, SIZES)
    + """SELECT buckets, CAST(sum(n) AS BIGINT) AS n_terms, count(*) AS n_used,
                CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_sharing
         FROM (SELECT buckets, bucket, count(*) AS n FROM placed GROUP BY buckets, bucket) GROUP BY buckets""",
)
def hash_collisions(spark, folder):
    _, counted = term_table(spark, folder)
    return I.collisions(counted, hash_sizes(spark, counted))


@query("tf", TFIDF + "SELECT doc_id, term, n FROM tf")
def tf(spark, folder):
    return I.term_counts(documents(spark, folder))


@query("idf", TFIDF + "SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf(spark, folder):
    docs, counted = term_table(spark, folder)
    return I.idf(counted, docs).withColumn("idf", F.round("idf", 6))


@query("tfidf", TFIDF + "SELECT doc_id, term, round(v, 6) AS tfidf FROM tfidf")
def tfidf(spark, folder):
    return rounded(tfidf_table(spark, folder))


@query(
    "tfidf_normalised",
    TFIDF
    + """SELECT doc_id, term, round(v / length, 6) AS tfidf
         FROM tfidf JOIN lengths USING (doc_id) WHERE length > 0""",
)
def tfidf_normalised(spark, folder):
    return rounded(I.normalised(tfidf_table(spark, folder)))


def line_terms(spark):
    """``(qid, term, n)`` of the query lines (parameters of the search)."""
    lines = spark.createDataFrame(list(LINES.items()), "doc_id bigint, text string")
    counted = I.term_counts(lines.withColumn("toks", T.tokens(T.normalize(F.col("text")))))
    return counted.withColumnRenamed("doc_id", "qid")


TOPK_SQL = (
    P.with_(
        DOC_TOKENS,
        "lines AS (SELECT * FROM (VALUES "
        + ", ".join(f"(CAST({i} AS BIGINT), '{t}')" for i, t in LINES.items())
        + ") AS t(qid, text))",
        f"""asked AS (SELECT qid, term, count(*) AS n FROM (
              SELECT qid, unnest(string_split({P.norm('text')}, ' ')) AS term FROM lines) GROUP BY qid, term),
        q AS (SELECT qid, term, n * idf AS q FROM asked JOIN idf USING (term)),
        qlen AS (SELECT qid, sqrt(sum(q * q)) AS qlength FROM q GROUP BY qid),
        dots AS (SELECT qid, doc_id, sum(q * v) AS dot FROM q JOIN tfidf USING (term) GROUP BY qid, doc_id),
        sims AS (SELECT qid, doc_id, round(dot / (length * qlength), 6) AS similarity
                 FROM dots JOIN lengths USING (doc_id) JOIN qlen USING (qid)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS rn
                   FROM sims)""",
    )
    + """SELECT qid, doc_id, similarity, CAST(rn AS INTEGER) AS rank, source, text AS definition
         FROM ranked JOIN documents USING (doc_id) WHERE rn <= 10"""
)


@query("tfidf_topk", TOPK_SQL)
def tfidf_topk(spark, folder):
    docs, counted = term_table(spark, folder)
    best = I.retrieve(counted, I.idf(counted, docs), line_terms(spark), 10)
    texts = V.table(spark, folder, "documents").select("doc_id", "source", F.col("text").alias("definition"))
    return best.join(texts, "doc_id")


@query("tfidf_topk_indexed", TOPK_SQL)
def tfidf_topk_indexed(spark, folder):
    """The same search over an impact-ordered index, opened only as far as needed."""
    docs, counted = term_table(spark, folder)
    weights = written(I.idf(counted, docs), "idf")
    entries = I.impact_entries(counted, weights)
    best, _ = I.retrieve_indexed(impact.index(entries), entries, weights, line_terms(spark), 10)
    texts = V.table(spark, folder, "documents").select("doc_id", "source", F.col("text").alias("definition"))
    return best.join(texts, "doc_id")


STRONGEST = f"""rounded AS MATERIALIZED (SELECT doc_id, term, round(v, 6) AS tfidf FROM tfidf),
strongest AS MATERIALIZED (SELECT * FROM rounded ORDER BY tfidf DESC, doc_id, term LIMIT {TOP}),
kept AS (SELECT * FROM rounded WHERE tfidf >= (SELECT min(tfidf) FROM strongest))"""


@query("tfidf_global_topn", P.with_(DOC_TOKENS, STRONGEST) + "SELECT doc_id, term, tfidf FROM strongest")
def tfidf_global_topn(spark, folder):
    return I.strongest(rounded(tfidf_table(spark, folder)), TOP)


@query("tfidf_feature_reduction", P.with_(DOC_TOKENS, STRONGEST) + "SELECT doc_id, term, tfidf FROM kept")
def tfidf_feature_reduction(spark, folder):
    return I.reduce_features(rounded(tfidf_table(spark, folder)), TOP)


@query(
    "feature_rows",
    P.with_(P.BAG_TEXT, P.BAGS, P.WEIGHTS_V1, DOC_TOKENS, STRONGEST)
    + """, edges AS (
           SELECT w.word AS src, d.def AS dst, tenths
           FROM clean_bags JOIN weights USING (category), unnest(words) AS w(word), unnest(defs) AS d(def)
           SEMI JOIN kept k ON k.doc_id = src_id AND k.term = d.def WHERE category <> 'associated'),
         summed AS (SELECT src, dst, sum(tenths) AS w FROM edges GROUP BY src, dst),
         row_max AS (SELECT src, max(w) AS m FROM summed GROUP BY src),
         label_ids AS (SELECT row_number() OVER (ORDER BY src) - 1 AS id, src
                       FROM (SELECT DISTINCT src FROM edges)),
         feature_ids AS (SELECT row_number() OVER (ORDER BY dst) - 1 AS id, dst
                         FROM (SELECT DISTINCT dst FROM edges))
         SELECT l.id AS label, f.id AS feature,
                CAST((2000 * s.w + m) // (2 * m) AS BIGINT) / 1000.0::DOUBLE AS value
         FROM summed s JOIN row_max USING (src) JOIN label_ids l USING (src) JOIN feature_ids f USING (dst)""",
)
def feature_rows(spark, folder):
    # stored, so that its real size is known before the pairs are joined with it: where it is small they stay in place
    kept = written(I.reduce_features(rounded(tfidf_table(spark, folder)), TOP).select(
        F.col("doc_id").alias("src_id"), F.col("term").alias("dst")
    ), "kept")
    bags = V.clean_bags(V.document_text(spark, folder)).where("category <> 'associated'")
    pairs = B.weigh(bags).select(
        "src_id", F.explode("defs").alias("dst"), "words", "tenths"
    ).join(kept, ["src_id", "dst"], "left_semi")
    edges = written(pairs.select(F.explode("words").alias("src"), "dst", "tenths"), "edges")
    summed = G.combine_sum(edges)
    row_max = summed.groupBy("src").agg(F.max("w").alias("m"))
    matrix = D.to_index(summed.join(row_max, "src"), D.build(edges, "src"), D.build(edges, "dst"))
    # three decimals, half up, in whole numbers
    value = F.expr("(2000 * w + m) div (2 * m)") / 1000.0
    return matrix.select(
        F.col("wid_from").alias("label"), F.col("wid_to").alias("feature"), value.alias("value")
    )


LETTER_COLS = ", ".join(
    f"CAST(length(t) - length(replace(t, '{c}', '')) AS INTEGER) AS f_{c.lower()}" for c in C.LETTERS
)
DOC_TEXT = f"doc_text AS (SELECT doc_id, lang, {P.norm('text')} AS t FROM documents)"
LETTERS = f"""{DOC_TEXT},
wide AS (SELECT doc_id, lang, {LETTER_COLS} FROM doc_text),
letters AS (
  SELECT doc_id, lang AS label, upper(right(feature, 1)) AS feature, CAST(n AS BIGINT) AS n
  FROM (UNPIVOT wide ON COLUMNS('f_.') INTO NAME feature VALUE n) WHERE n > 0)"""


def letter_text(spark, folder):
    return spread(V.table(spark, folder, "documents").select("doc_id", "lang", "text")).select(
        "doc_id", F.col("lang").alias("label"), T.normalize(F.col("text")).alias("t")
    )


@query("letter_features", P.with_(LETTERS) + "SELECT doc_id, lang AS label, * EXCLUDE (doc_id, lang) FROM wide")
def letter_features(spark, folder):
    return C.letter_features(letter_text(spark, folder), "t")


CHAR_TFIDF = """char_idf AS (
  SELECT feature, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf
  FROM letters GROUP BY feature),
ids AS (SELECT row_number() OVER (ORDER BY lang) - 1 AS label, lang FROM (SELECT DISTINCT lang FROM documents)),
char_tfidf AS (
  SELECT doc_id, i.label, feature, round(n * idf, 6) AS n
  FROM letters l JOIN char_idf USING (feature) JOIN ids i ON i.lang = l.label)"""


def lettered(spark, folder):
    """``(doc_id, label, counts)``: letter counts as one array per document."""
    return letter_text(spark, folder).select("doc_id", "label", C.letter_array(F.col("t")).alias("counts"))


def lang_ids(spark, folder):
    """Map from language to dictionary id; the languages are the classes, so they are few."""
    ids = D.build(V.table(spark, folder, "documents"), "lang")
    return ids.agg(F.map_from_entries(F.collect_list(F.struct("word", "wid")))).scalar()


def char_tfidf_table(spark, folder):
    """``(doc_id, label, counts)``: letter TF-IDF with dictionary ids of the language.

    The 26 document frequencies are one row, so no letter is ever a join key.
    """
    rows = written(lettered(spark, folder), "letters")
    holding = F.array(*[F.count(F.get("counts", F.lit(i))) for i in range(len(C.LETTERS))])
    weights = rows.agg(F.count(F.lit(1)).alias("n"), holding.alias("df")).select(
        F.transform("df", lambda df: F.log((F.col("n") + 1) / (df + 1)))
    )
    keyed = rows.select(
        "doc_id", "counts", F.try_element_at(lang_ids(spark, folder), F.col("label")).alias("label"),
        weights.scalar().alias("idf"),
    ).where("label IS NOT NULL")
    weighted = F.zip_with("counts", "idf", lambda n, w: F.round(n * w, 6))
    return keyed.select("doc_id", "label", weighted.alias("counts"))


def letter_cells(values):
    """``(feature, value)`` structs of an array over the letters, without the absent ones."""
    letters = F.array(*[F.lit(c) for c in C.LETTERS])
    cells = F.zip_with(letters, values, lambda c, v: F.struct(c.alias("feature"), v.alias("value")))
    return F.filter(cells, lambda cell: cell["value"].isNotNull())


@query(
    "char_tfidf",
    P.with_(LETTERS, CHAR_TFIDF) + "SELECT doc_id, label, feature, n AS value FROM char_tfidf",
)
def char_tfidf(spark, folder):
    return each_struct(char_tfidf_table(spark, folder), letter_cells("counts"), "feature", "doc_id", "label")


@query(
    "split_hash",
    """SELECT doc_id, CASE WHEN left(md5(CAST(doc_id AS VARCHAR)), 2) < 'cc' THEN 'train' ELSE 'test' END AS part
       FROM documents""",
)
def split_hash(spark, folder):
    docs = V.table(spark, folder, "documents").select("doc_id")
    return docs.withColumn("part", F.when(C.hash_split(docs, "doc_id", "cc"), "train").otherwise("test"))


def nb_sql(source: str, examples: str) -> str:
    """Model and prediction CTEs over ``source(doc_id, label, feature, n)``."""
    return f"""split AS (SELECT *, left(md5(CAST(doc_id AS VARCHAR)), 2) < 'cc' AS train FROM {source}),
truth AS (SELECT doc_id, label, left(md5(CAST(doc_id AS VARCHAR)), 2) < 'cc' AS train FROM {examples}),
sums AS (SELECT label, feature, sum(n) AS s FROM split WHERE train GROUP BY label, feature),
priors AS (
  SELECT label, ln((count(*) + 1.0) / ((SELECT count(*) FROM truth WHERE train)
                                       + (SELECT count(DISTINCT label) FROM truth WHERE train))) AS prior
  FROM truth WHERE train GROUP BY label),
likelihood AS (
  SELECT p.label, f.feature,
         ln((coalesce(s, 0) + 1.0) / (t.total + (SELECT count(DISTINCT feature) FROM sums))) AS value
  FROM priors p CROSS JOIN (SELECT DISTINCT feature FROM sums) f
  LEFT JOIN sums USING (label, feature)
  JOIN (SELECT label, sum(s) AS total FROM sums GROUP BY label) t ON t.label = p.label),
scores AS (
  SELECT doc_id, l.label, sum(n * value) + any_value(prior) AS score
  FROM split x JOIN likelihood l USING (feature) JOIN priors p ON p.label = l.label
  WHERE NOT train GROUP BY doc_id, l.label),
predicted AS (SELECT doc_id, arg_max(label, score) AS label FROM scores GROUP BY doc_id)"""


ACCURACY = """SELECT CAST(count(*) AS BIGINT) AS n_test,
  CAST(count(*) FILTER (p.label = t.label) AS BIGINT) AS n_right,
  count(*) FILTER (p.label = t.label) / count(*) AS accuracy
  FROM truth t LEFT JOIN predicted p USING (doc_id) WHERE NOT train"""


def evaluate(examples):
    """Train on four fifths of the documents and score the rest."""
    train = C.hash_split(examples, "doc_id", "cc")
    model = C.naive_bayes(examples.where(train))
    return C.accuracy(C.predict(model, examples.where(~train)))


@query(
    "nb_model",
    P.with_(LETTERS, nb_sql("letters", "(SELECT doc_id, lang AS label FROM documents)"))
    + """SELECT label, '' AS feature, round(prior, 6) AS value FROM priors
         UNION ALL SELECT label, feature, round(value, 6) FROM likelihood""",
)
def nb_model(spark, folder):
    rows = lettered(spark, folder)
    model = C.naive_bayes(rows.where(C.hash_split(rows, "doc_id", "cc")))
    prior = F.array(F.struct(F.lit("").alias("feature"), F.col("prior").alias("value")))
    cells = F.concat(prior, letter_cells("values"))
    labelled = model.select(F.inline("model"))
    return each_struct(labelled, cells, "feature", "label").withColumn("value", F.round("value", 6))


@query(
    "nb_accuracy",
    P.with_(LETTERS, nb_sql("letters", "(SELECT doc_id, lang AS label FROM documents)")) + ACCURACY,
)
def nb_accuracy(spark, folder):
    return evaluate(written(lettered(spark, folder), "letters"))


@query(
    "nb_accuracy_tfidf",
    P.with_(
        LETTERS,
        CHAR_TFIDF,
        nb_sql("char_tfidf", "(SELECT doc_id, label FROM documents JOIN ids USING (lang))"),
    )
    + ACCURACY,
)
def nb_accuracy_tfidf(spark, folder):
    return evaluate(char_tfidf_table(spark, folder))


def labelled_letters(spark, folder):
    wide = C.letter_features(letter_text(spark, folder), "t")
    keyed = wide.withColumn("wid", F.try_element_at(lang_ids(spark, folder), F.col("label"))).drop("label")
    columns = [f"f_{c.lower()}" for c in C.LETTERS]
    return C.labelled_vectors(keyed.where("wid IS NOT NULL"), columns, "wid").select(
        "doc_id", "label", "features"
    )


@query(
    "dt_split_gains",
    P.with_(LETTERS)
    + """, cells AS (SELECT doc_id, lang AS label, ascii(right(feature, 1)) - ascii('a') AS feature, CAST(n AS BIGINT) AS v
           FROM (UNPIVOT wide ON COLUMNS('f_.') INTO NAME feature VALUE n)),
         widths AS (SELECT feature, max(v) AS most FROM cells GROUP BY feature),
         hist AS (SELECT feature, v * 32 // (most + 1) AS bin, label, count(*) AS n
                  FROM cells JOIN widths USING (feature) GROUP BY ALL),
         parts AS (SELECT h.feature, c.cut, label, sum(n) AS t, coalesce(sum(n) FILTER (bin <= c.cut), 0) AS l
                   FROM hist h, (SELECT unnest(range(31)) AS cut) c GROUP BY h.feature, c.cut, label),
         gains AS (SELECT feature, cut, sum(l) AS nl, sum(t - l) AS nr,
                     (sum(l * l)::DOUBLE / sum(l) + sum((t - l) * (t - l))::DOUBLE / sum(t - l)
                      - sum(t * t)::DOUBLE / sum(t)) / sum(t) AS gain
                   FROM parts GROUP BY feature, cut HAVING sum(l) > 0 AND sum(t - l) > 0),
         rounded AS (SELECT *, round(gain, 9) AS g FROM gains)
         SELECT CAST(feature AS INTEGER) AS feature, CAST(cut AS INTEGER) AS cut, CAST(nl AS BIGINT) AS n_left,
                CAST(nr AS BIGINT) AS n_right, g AS gain,
                row_number() OVER (ORDER BY g DESC, feature, cut) = 1 AS best FROM rounded""",
)
def dt_split_gains(spark, folder):
    """Gini gains of all binned splits at the root of a letter tree, with the best one."""
    rows = written(lettered(spark, folder).select("label", "counts"), "letters")
    return C.split_gains(written(C.histograms(rows, "counts"), "histograms"))


@query("dt_accuracy")
def dt_accuracy(spark, folder):
    rows = written(labelled_letters(spark, folder), "letters")
    train = C.hash_split(rows, "doc_id", "b3")
    model = C.train_tree(rows.where(train))
    return C.accuracy(model.transform(rows.where(~train)), guess="prediction")


@query(
    "vector_ops_sparse",
    TFIDF
    + """, corpus AS (SELECT term, CAST(sum(n) AS BIGINT) AS n FROM tf GROUP BY term),
         clen AS (SELECT sqrt(sum(n * n)) AS length FROM corpus)
         SELECT doc_id, CAST(sum(t.n * c.n) AS BIGINT) AS dot, round(sqrt(sum(t.n * t.n)), 6) AS length,
                round(sum(t.n * c.n) / (sqrt(sum(t.n * t.n)) * any_value(clen.length)), 6) AS cosine
         FROM tf t JOIN corpus c USING (term), clen GROUP BY doc_id""",
)
def vector_ops_sparse(spark, folder):
    counted = written(I.term_counts(documents(spark, folder)).withColumnRenamed("n", "v"), "tf")
    corpus = counted.groupBy("term").agg(F.sum("v").alias("v"))
    length = corpus.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))))
    both = I.sparse_dot(counted, corpus, "doc_id").join(I.sparse_norm(counted, "doc_id"), "doc_id")
    return both.select(
        "doc_id",
        "dot",
        F.round("norm", 6).alias("length"),
        F.round(F.col("dot") / (F.col("norm") * length.scalar()), 6).alias("cosine"),
    )


@query(
    "vector_ops_dense",
    """WITH cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos
                      FROM embeddings),
         centre AS (SELECT label, pos, avg(v) AS m FROM cells GROUP BY label, pos)
       SELECT vec_id, round(sum(v * m), 6) AS dot, round(sqrt(sum(v * v)), 6) AS length,
              round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS cosine
       FROM cells JOIN centre USING (label, pos) GROUP BY vec_id""",
)
def vector_ops_dense(spark, folder):
    rows = V.table(spark, folder, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(
        F.avg(F.col("v").cast("double")).alias("m")
    )
    # one array element per dimension and label
    centre = means.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("cells")
    ).select("label", F.col("cells.m").alias("centre"))
    a, b = F.col("embedding"), F.col("centre")
    # few labels hold all vectors
    return salted_join(rows, centre, ["label"], "label", F.col("vec_id")).select(
        "vec_id",
        F.round(X.dot(a, b), 6).alias("dot"),
        F.round(X.norm(a), 6).alias("length"),
        F.round(X.cosine(a, b), 6).alias("cosine"),
    )


def gappy(spark, folder):
    """Embeddings in which every coordinate below -0.25 counts as missing."""
    cells = F.transform("embedding", lambda v: F.when(v >= -0.25, v.cast("double")))
    return V.table(spark, folder, "embeddings").select("vec_id", cells.alias("y"))


@query(
    "column_stats",
    """WITH cells AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
         stats AS (SELECT pos, count(*) AS n, avg(v) AS mean, var_samp(v) AS variance
                   FROM cells WHERE v >= -0.25 GROUP BY pos)
       SELECT CAST(pos AS INTEGER) AS pos, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean,
              round(variance, 6) AS variance,
              round(100 * variance / (SELECT sum(variance) FROM stats), 6) AS percent FROM stats""",
)
def column_stats(spark, folder):
    stats = A.percent_variance(A.column_stats(gappy(spark, folder), "y"))
    return stats.select("pos", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "percent")])


PCA_SQL = """WITH RECURSIVE
cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings),
centred AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM cells),
entries AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / (count(*) - 1) AS c
            FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i),
cov AS MATERIALIZED (
  SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM entries GROUP BY i)),
first(step, m) AS (
  SELECT 0, m FROM cov
  UNION ALL
  SELECT step + 1, list_transform(s, lambda r: list_transform(r, lambda x: x / t)) FROM (
    SELECT step, s, list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i][i])) AS t FROM (
      SELECT step, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS s
      FROM first WHERE step < 18))),
turned1 AS MATERIALIZED (
  SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (
    SELECT m[list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]),
                           list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i])))] AS v
    FROM first WHERE step = 18)),
rest AS MATERIALIZED (
  SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - e * v[i] * v[j])) AS m
  FROM (SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS e FROM cov, turned1)),
second(step, m) AS (
  SELECT 0, m FROM rest
  UNION ALL
  SELECT step + 1, list_transform(s, lambda r: list_transform(r, lambda x: x / t)) FROM (
    SELECT step, s, list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i][i])) AS t FROM (
      SELECT step, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS s
      FROM second WHERE step < 18))),
turned2 AS MATERIALIZED (
  SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (
    SELECT m[list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]),
                           list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i])))] AS v
    FROM second WHERE step = 18)),
signs AS (
  SELECT list_transform(a, lambda x: x * sign(a[list_position(list_transform(a, lambda y: abs(y)), list_max(list_transform(a, lambda y: abs(y))))])) AS a,
         list_transform(b, lambda x: x * sign(b[list_position(list_transform(b, lambda y: abs(y)), list_max(list_transform(b, lambda y: abs(y))))])) AS b
  FROM (SELECT turned1.v AS a, turned2.v AS b FROM turned1, turned2))
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], a), 4) AS pc1,
       round(list_dot_product(embedding::DOUBLE[], b), 4) AS pc2 FROM embeddings, signs"""


@query("pca_embeddings", PCA_SQL)
def pca_embeddings(spark, folder):
    scored, _, _ = A.pca(V.table(spark, folder, "embeddings"), "embedding", 2)
    return scored.select("vec_id", F.round(F.col("scores")[0], 4).alias("pc1"), F.round(F.col("scores")[1], 4).alias("pc2"))


@query("ppca_embeddings")
def ppca_embeddings(spark, folder):
    fitted = A.ppca(gappy(spark, folder), "vec_id", "y", k=2)
    return fitted.completed.select("vec_id", F.col("x")[0].alias("pc1"), F.col("x")[1].alias("pc2"))
