"""Exact TF-IDF on tall ``(doc_id, term, n)`` tables and vector-space retrieval."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clueweave.operators import impact
from clueweave.operators.search import top_k
from clueweave.operators.sums import cross_sums
from clueweave.session import written

#: similarities are compared at this many decimals, so copies of a text tie exactly
DECIMALS = 6


def term_counts(docs: DataFrame, tokens: str = "toks") -> DataFrame:
    """``(doc_id, term, n)`` of token arrays; a document is shuffled once, as the list of its terms."""
    lists = docs.select(F.array("doc_id").alias("srcs"), F.col(tokens).alias("dsts"), F.lit(1).cast("bigint").alias("w"))
    return cross_sums(lists).where("dst IS NOT NULL").toDF("doc_id", "term", "n")


def idf(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term, df, idf)`` with idf = ln((documents + 1) / (df + 1))."""
    total = docs.agg(F.count(F.lit(1)))
    return (
        tf.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", F.log((total.scalar() + 1) / (F.col("df") + 1)))
    )


def tfidf(tf: DataFrame, weights: DataFrame) -> DataFrame:
    return tf.join(weights.select("term", "idf"), "term").select(
        "doc_id", "term", (F.col("n") * F.col("idf")).alias("tfidf")
    )


def lengths(values: DataFrame) -> DataFrame:
    """Euclidean length of every document vector."""
    squared = F.sum(F.col("tfidf") * F.col("tfidf"))
    return values.groupBy("doc_id").agg(F.sqrt(squared).alias("length"))


def normalised(values: DataFrame) -> DataFrame:
    """Vectors of length one; documents whose terms all have idf 0 have none."""
    length = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy("doc_id")))
    known = values.where("doc_id IS NOT NULL").withColumn("length", length).where("length > 0")
    return known.select("doc_id", "term", (F.col("tfidf") / F.col("length")).alias("tfidf"))


def impact_entries(tf: DataFrame, weights: DataFrame) -> DataFrame:
    """Stored ``(key, item, w)``: the share of each term in its document's length.

    With documents of length one, a cosine is a sum over the terms of a query.
    """
    shares = normalised(tfidf(tf, weights)).where("tfidf > 0")
    return written(shares.select(F.col("term").alias("key"), F.col("doc_id").alias("item"), F.col("tfidf").alias("w")), "shares")


def retrieve_indexed(
    blocks: DataFrame, entries: DataFrame, weights: DataFrame, queries: DataFrame, k: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Top ``k`` documents per query by cosine, and the postings read for each query.

    ``entries`` are the :func:`impact_entries` of the collection and ``blocks`` their index;
    ``queries`` is ``(qid, term, n)``.
    """
    asked = queries.join(weights.where("idf > 0").select("term", "idf"), "term").select(
        "qid", F.col("term").alias("key"), (F.col("n") * F.col("idf")).alias("q")
    )
    length = Window.partitionBy("qid")
    asked = asked.withColumn("q", F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(length)))
    found, read = impact.top_sums(
        blocks, entries, asked, k, slack=2 * 10.0**-DECIMALS, shown=lambda s: F.round(s, DECIMALS)
    )
    return found.select("qid", F.col("item").alias("doc_id"), F.col("score").alias("similarity"), "rank"), read


def retrieve(tf: DataFrame, weights: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` documents per query by cosine; ``queries`` is ``(qid, term, n)``.

    Only terms of a query are matched, and terms of idf 0 cannot change a score.  This scores every
    document that shares a term; many queries over one collection should ask its stored index
    (:func:`retrieve_indexed`).
    """
    values = tfidf(tf, weights)
    asked = queries.join(weights.where("idf <> 0").select("term", "idf"), "term").select(
        "qid", "term", (F.col("n") * F.col("idf")).alias("q")
    )
    query_length = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qlength"))
    dots = values.join(asked, "term").groupBy("qid", "doc_id").agg(
        F.sum(F.col("q") * F.col("tfidf")).alias("dot")
    )
    similar = (
        dots.join(lengths(values), "doc_id")
        .join(query_length, "qid")
        .select(
            "qid",
            "doc_id",
            F.round(F.col("dot") / (F.col("length") * F.col("qlength")), DECIMALS).alias("similarity"),
        )
    )
    return top_k(similar, ["qid"], [F.desc("similarity"), F.col("doc_id")], k)


def strongest(values: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest TF-IDF values of the whole collection."""
    return values.orderBy(F.desc("tfidf"), "doc_id", "term").limit(n)


def reduce_features(values: DataFrame, n: int) -> DataFrame:
    """Document terms whose value reaches the smallest of the ``n`` largest values."""
    least = strongest(values, n).agg(F.min("tfidf"))
    return values.where(F.col("tfidf") >= least.scalar())


def hashed_tfidf(docs: DataFrame, buckets: int, tokens: str = "toks") -> DataFrame:
    """MLlib form: hashed term frequencies, IDF and unit length in column ``features``."""
    counted = HashingTF(numFeatures=buckets, inputCol=tokens, outputCol="_tf").transform(docs)
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted).transform(counted)
    return Normalizer(inputCol="_tfidf", outputCol="features").transform(weighted).drop("_tf", "_tfidf")


#: counts that one task hashes, whatever the size of the input
HASHED_PER_TASK = 400_000


def _number(term: Column) -> Column:
    """First 32 bits of the MD5 of a term: the same in any engine."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def bucket(term: Column, buckets: Column | int) -> Column:
    """Place of a term among ``buckets``."""
    return F.pmod(_number(term), F.lit(buckets) if isinstance(buckets, int) else buckets)


def hashed_counts(tf: DataFrame, buckets: DataFrame) -> DataFrame:
    """``(doc_id, buckets, bucket, n)``: term counts hashed into each of the sizes ``buckets``.

    ``buckets`` has one row per size; terms that share a bucket add up.  The counts of a document
    meet once, before they are copied for the sizes, and the number of tasks follows the rows of
    ``tf`` (counted beforehand: pass a stored table), so that of one task stays the same.
    """
    sizes = buckets.agg(F.collect_list("buckets")).scalar()
    tasks = max(-(-tf.count() // HASHED_PER_TASK), 1)
    met = tf.select("doc_id", _number(F.col("term")).alias("number"), "n").repartition(tasks, "doc_id")
    spread = met.select("doc_id", "number", "n", F.explode(sizes).alias("buckets"))
    placed = spread.withColumn("bucket", F.pmod("number", "buckets"))
    return placed.groupBy("doc_id", "buckets", "bucket").agg(F.sum("n").alias("n"))


def collisions(terms: DataFrame, buckets: DataFrame) -> DataFrame:
    """Per size: distinct terms, buckets in use, and terms that share one with another."""
    sizes = buckets.agg(F.collect_list("buckets")).scalar()
    placed = terms.select("term").distinct().select("term", F.explode(sizes).alias("buckets"))
    used = placed.groupBy("buckets", bucket(F.col("term"), F.col("buckets")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return used.groupBy("buckets").agg(
        F.sum("n").alias("n_terms"), F.count(F.lit(1)).alias("n_used"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_sharing"),
    )


def sparse_dot(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Dot product of tall sparse vectors ``(<by>, term, v)`` of ``a`` with the one vector ``b``."""
    return (
        a.join(b.select("term", F.col("v").alias("w")), "term")
        .groupBy(by)
        .agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    )


def sparse_add(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    return a.unionByName(b).groupBy(by, "term").agg(F.sum("v").alias("v"))


def sparse_scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * factor)


def sparse_norm(a: DataFrame, by: str) -> DataFrame:
    return a.groupBy(by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
