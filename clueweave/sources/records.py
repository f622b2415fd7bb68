"""Puzzle and dictionary records as JSON, relational tables and XML dump pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clueweave.session import written

ENTRIES_PER_FILE = 1000
BYTES_PER_FILE = 64 << 20

PLACED = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("clue", T.StringType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("dir", T.StringType()),
    ]
)

#: ``categories`` is read as raw text because some writers store a bare string
PUZZLE = T.StructType(
    [
        *[
            T.StructField(name, T.StringType())
            for name in ("source", "language", "title", "url", "date", "author", "categories")
        ],
        T.StructField("words", T.ArrayType(PLACED)),
    ]
)

ENTRY_LISTS = ("equivalents", "associated", "other", "definitions", "examples")

ENTRY = T.StructType(
    [T.StructField("word", T.StringType())]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in ENTRY_LISTS]
)


def _json(spark: SparkSession, path: str, schema: T.StructType, pattern: str) -> DataFrame:
    """One row per top-level object of every file below ``path`` whose name fits (any codec).

    An array file gives one row per element.  Whole-file JSON cannot be split, so large
    collections should be stored as Parquet after the first read.
    """
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(path)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )


def read_puzzles(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """Puzzle records; ``categories`` becomes an array whether it was a list or a string."""
    raw = F.col("categories")
    listed = F.from_json(raw, "array<string>")
    return _json(spark, path, PUZZLE, pattern).withColumn(
        "categories",
        F.when(raw.isNull(), F.lit(None)).when(F.startswith(F.ltrim(raw), F.lit("[")), listed).otherwise(F.array(raw)),
    )


def read_entries(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    return _json(spark, path, ENTRY, pattern)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of JSON lines, the form :func:`write_json` writes; such files can be split."""
    return spark.read.schema(schema).json(path)


def nested_objects(rows: DataFrame, column: str) -> DataFrame:
    """``value`` (VARIANT): the objects in the JSON texts of ``column``, at any depth of arrays.

    Each round takes one level of arrays apart and stores what it gives, so the plan does not grow
    with the depth; rounds go on while arrays are left.  Numbers, strings and nulls inside arrays
    are no records, nor are texts that are not JSON.
    """
    level = written(rows.select(F.try_parse_json(column).alias("value")), "nested")
    found = None
    while True:
        kind = F.schema_of_variant("value")
        objects = level.where(F.startswith(kind, F.lit("OBJECT")))
        found = objects if found is None else found.union(objects)
        arrays = level.where(F.startswith(kind, F.lit("ARRAY"))).withColumnRenamed("value", "items")
        if arrays.isEmpty():
            return found
        inner = arrays.sparkSession.tvf.variant_explode(F.col("items").outer())
        level = written(arrays.lateralJoin(inner).select("value"), "nested")


def read_nested_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of files whose arrays are nested in arrays, to any depth.

    A file is one value here; :func:`clueweave.sources.ranges.read_json_records` reads files that
    are too large for that.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    entry = F.try_variant_get("value", "$", ENTRY.simpleString())
    return nested_objects(text, "value").select(entry.alias("e")).select("e.*")


def write_json(
    records: DataFrame, path: str, per_file: int = ENTRIES_PER_FILE, codec: str = "bzip2"
) -> None:
    """JSON lines, at most ``per_file`` records in each file."""
    records.write.option("maxRecordsPerFile", per_file).json(path, compression=codec)


def write_arrays(
    records: DataFrame, path: str, per_file: int = ENTRIES_PER_FILE,
    max_bytes: int = BYTES_PER_FILE, nested: int = 0, codec: str = "bzip2",
) -> None:
    """Array files of at most ``per_file`` records and ``max_bytes`` bytes (a larger record stands
    alone); record ``i`` of a file lies ``i % (nested + 1)`` arrays deeper than the first."""

    def packed(held: list[bytes]) -> pa.RecordBatch:
        whole = pa.py_buffer(b"[" + b",".join(held) + b"]")
        ends = pa.py_buffer(np.array([0, whole.size], np.int32))
        return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, ends, whole)], names=["value"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records stay bytes and are taken one by one, so a worker holds little more than a file."""
        held, size = [], 0
        for batch in batches:
            for value in batch.column("value").cast(pa.binary()):
                record = value.as_py()
                n = len(record) + 1 + 2 * nested
                if held and (len(held) == per_file or size + n > max_bytes):
                    yield packed(held)
                    held, size = [], 0
                deeper = len(held) % (nested + 1)
                held.append(b"[" * deeper + record + b"]" * deeper)
                size += n
        if held:
            yield packed(held)

    lines = records.select(F.to_json(F.struct("*")).alias("value"))
    arrays = lines.mapInArrow(pack, "value string")
    arrays.write.option("maxRecordsPerFile", 1).text(path, compression=codec)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(title, text)`` of the main-namespace pages of an XML dump."""
    schema = "title string, ns int, revision struct<text: string>"
    return (
        spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
        .where("ns = 0")
        .select("title", F.col("revision.text").alias("text"))
    )


def store_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Write named tables as Parquet folders below ``path``.

    ``neighbors`` is laid out by its target id, the column searches filter on.
    """
    for name, rows in tables.items():
        if name == "neighbors":
            rows = rows.repartitionByRange("wid_to").sortWithinPartitions("wid_to")
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
