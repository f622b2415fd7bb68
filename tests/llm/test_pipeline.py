"""The registered queries and the pipeline at the smallest scale."""

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from clueweave.llm import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).execute(ORACLES[name]).df()) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("d1", F.lit("x"))
    hostile = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")})
    docs = docs.unionByName(hostile).unionByName(docs.limit(3))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), corpus_pipeline.written(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == columns and 0 < docs.count() <= before
    assert corpus_pipeline.packing_stage(spark, docs, FOLDER).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
