"""Registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueweave.llm import (
    decontaminate,
    embedding_dedup,
    html_text,
    license_scan,
    line_dedup,
    packing,
    quality,
    simhash_dedup,
    spelling_variants,
    substring_dedup,
    token_alignment,
    token_store,
    toxicity,
)
from clueweave.llm.common import table, two_hashes
from clueweave.llm.encode import default_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: A line is boilerplate from so many distinct sources on.
MIN_SITES = 10
LONGEST_SEQUENCE = 1024
#: SimHash near-dedup: words of a shingle, and bits that linked fingerprints may differ in.
SHINGLE_WORDS, RADIUS = 4, 4
#: One word in so many loses a letter before variants are grouped.
MISSPELT = 199


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_embedding_dedup", embedding_dedup.SQL)
def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of a label at cosine 0.98."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"), cosine=0.98)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of ``docs`` with the digest of their ids."""
    pieces = packing.decompose(
        docs, default_path("byte_bpe_50k.json"), "blank", end_id=0, longest=LONGEST_SEQUENCE
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as power-of-two pieces, one per sequence."""
    return packed(table(spark, folder, "documents"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` of the quality classifier."""
    model = quality.fit(docs, labels)
    return docs.withColumn("held_out", quality.held_out(F.col("doc_id"))).withColumn(
        "score", quality.score(model, F.col("text"))
    )


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, predicted good from the threshold on."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scored(docs, table(spark, folder, "labels")).select(
        "doc_id", "held_out", "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a window like a benchmark item, and the item."""
    return decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query("op5_line_dedup", line_dedup.SQL.format(min_sites=MIN_SITES))
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that many sources share."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, MIN_SITES).select(
        "doc_id", "text", "n_lines", "n_removed"
    )


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that stand elsewhere too."""
    found = substring_dedup.remove_repeats(table(spark, folder, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Places of license phrases in every document.

    Votes are counted per distinct text, so copies are found once and repeated rows keep apart.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    k1, k2 = two_hashes(F.col("text"))
    keyed = docs.withColumn("k1", k1).withColumn("k2", k2)
    found = license_scan.spans(keyed, ["k1", "k2"]).groupBy("k1", "k2").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    counted = keyed.select(
        "doc_id", "k1", "k2", F.size(license_scan.words(F.col("text"))).cast("bigint").alias("n_words")
    )
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return counted.join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"),
        F.col("first_word").cast("bigint"), F.col("last_word").cast("bigint"),
        listed("base_labels").alias("base_labels"), listed("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


@query("op8_html_text")
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    # marked so that the length does not extract a second time
    pages = table(spark, folder, "pages").select(
        "page_id", "url", html_text.extract.asNondeterministic()("html").alias("text")
    )
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op9_simhash_dedup")
def op9_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash_dedup.near_duplicates(
        table(spark, folder, "documents"), size=SHINGLE_WORDS, radius=RADIUS
    )


@query("op10_token_store")
def op10_token_store(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as token files and read back."""
    docs = table(spark, folder, "documents")
    return token_store.read_store(
        token_store.write_store(docs, default_path("word_bpe_49k.json"), "space", end_id=2)
    )


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = docs.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        toxicity.score(model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op12_spelling_variants", spelling_variants.SQL)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Near words, forms and roots of the frequent words of all documents."""
    runs = spelling_variants.runs(table(spark, folder, "documents").select("doc_id", "text"))
    spelt = spelling_variants.misspelt(F.col("doc_id"), F.col("run"), MISSPELT)
    words = spelling_variants.vocabulary(runs.select(spelt.alias("word")))
    return spelling_variants.variants(words)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups, links and corpus-wide counts of linked ids of two tokenizers."""
    return token_alignment.link_report(
        table(spark, folder, "documents"),
        default_path("byte_bpe_50k.json"),
        default_path("piece_bpe_32k.model"),
    )
