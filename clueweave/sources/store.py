"""A growing store of puzzles: four tables, appended to in batches, with ids that never change.

A batch adds the puzzles whose key the store does not know yet.  Words keep their ids; new words and
puzzles continue behind the largest id in use, numbered range by range.  Every batch writes folders
of its own and then one manifest that names all folders of the new version.  Readers take the newest
manifest, so they see a batch whole or not at all, and what a failed append leaves behind is named by
no manifest.  One writer at a time: a second one that claims the same version fails.

Defined cases: several records of one key count once (the smallest as JSON); null key parts are
equal to each other; items without a word and empty categories are dropped; an empty batch adds
nothing but a version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clueweave.operators.dictionary import max_id, numbered
from clueweave.session import written

SCHEMAS = {
    "puzzles": "cwid bigint, source string, language string, title string, url string, date string, author string",
    "words": "wid bigint, word string",
    "items": "cwid bigint, wid bigint, x int, y int, clue string, dir string",
    "categories": "cwid bigint, category string",
}
_MANIFEST = "name string, folder string, version int"
KEY = ("source", "url", "date")


def _manifest(spark: SparkSession, path: str) -> list:
    """Rows of the newest manifest; it is small, four rows per batch."""
    try:
        rows = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{path}/manifest")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    newest = rows.agg(F.max("version")).scalar()
    return rows.where(F.col("version") == newest).select("name", "folder", "version").collect()


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables at the newest version; empty ones for a store without any."""
    return _tables(spark, path, _manifest(spark, path))


def _tables(spark: SparkSession, path: str, manifest: list) -> dict[str, DataFrame]:
    out = {}
    for name, schema in SCHEMAS.items():
        folders = [f"{path}/{r.folder}" for r in manifest if r.name == name]
        reader = spark.read.schema(schema)
        out[name] = reader.parquet(*folders) if folders else spark.createDataFrame([], schema)
    return out


def append(spark: SparkSession, path: str, records: DataFrame, key: tuple[str, ...] = KEY) -> int:
    """Add the puzzle ``records`` (as ``sources.records.PUZZLE``) that are new; the new version."""
    manifest = _manifest(spark, path)
    known = _tables(spark, path, manifest)
    version = 1 + max((r.version for r in manifest), default=0)

    whole = F.struct(*(f"`{c}`" for c in records.columns))
    one_each = records.groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    fresh = one_each.alias("n").join(known["puzzles"].alias("o"), same, "left_anti")
    next_puzzle = 1 + max_id(known["puzzles"], "cwid").scalar()
    fresh = written(numbered(fresh, list(key), "cwid").withColumn("cwid", F.col("cwid") + next_puzzle), "batch")

    placed = fresh.select("cwid", F.explode("words").alias("w")).select("cwid", "w.*").where("word IS NOT NULL")
    unknown = placed.select("word").distinct().join(known["words"], "word", "left_anti")
    next_word = 1 + max_id(known["words"], "wid").scalar()
    new_words = numbered(unknown, ["word"], "wid").select((F.col("wid") + next_word).alias("wid"), "word")
    new_words = written(new_words, "new-words")

    parts = {
        "puzzles": fresh,
        "words": new_words,
        "items": placed.join(known["words"].unionByName(new_words), "word").distinct(),
        "categories": fresh.select("cwid", F.explode("categories").alias("category"))
        .where("category <> ''").distinct(),
    }
    rows = [(r.name, r.folder, version) for r in manifest]
    for name, part in parts.items():
        folder = f"data/{name}-{version}-{uuid.uuid4().hex}"
        columns = spark.createDataFrame([], SCHEMAS[name]).columns
        part.select(columns).write.parquet(f"{path}/{folder}")
        rows.append((name, folder, version))
    # one file, moved into place by the committer: the version exists from that moment on
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{path}/manifest/v{version:06d}")
    return version
