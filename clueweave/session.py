"""Session settings, shared scratch storage and scan parallelism."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold on a laptop and on a cluster; sizes are left to the deployment.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Optional number of partitions for scans of text tables, see :func:`spread`.
SCAN_PARTITIONS = "spark.clueweave.scan.partitions"


def get_session(app: str = "clueweave", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the library defaults plus ``conf``.

    Keyword names use ``__`` for dots: ``spark__sql__shuffle__partitions="16"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to storage shared by all executors")
    own = tempfile.mkdtemp(prefix="clueweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new name below the application's part of the shared folder."""
    return os.path.join(
        shared_dir(spark), spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}"
    )


def written(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage durably (a lost executor only re-reads files) and, unlike an
    RDD checkpoint, keeps column pruning and gives later joins a real size estimate.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Re-distribute a scan over as many partitions as the session asks for, if it does.

    Set ``spark.clueweave.scan.partitions`` where inputs are small files with one row group, which
    a scan cannot split.  Unset, as on large inputs, the scan stays as it is.
    """
    wanted = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df
