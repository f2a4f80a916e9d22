"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder; others must set it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="basalt-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001  at exit the session may already be gone
        pass


#: Files of a partitioned table that one task holds open; with more values in a task, its rows are sorted by them.
OPEN_FILES = 16


def written(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """``df`` written once and read back: its lineage ends there, so plans of loops stay short and survive lost executors.

    ``by`` is a column of few values, each of which gets its own files, so that only those asked for are read. Files go when
    the process ends, or by ``forgotten`` once nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
    else:
        before = spark.conf.get(_OPEN, None)
        spark.conf.set(_OPEN, OPEN_FILES)
        try:
            df.write.option("compression", "zstd").partitionBy(by).parquet(path)
        finally:
            spark.conf.unset(_OPEN) if before is None else spark.conf.set(_OPEN, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    out._written_to = path
    return out


def forgotten(df: DataFrame | None) -> None:
    """Remove the files of a written table that a loop has replaced by its next round's."""
    path = getattr(df, "_written_to", None)
    if path:
        _remove(df.sparkSession, path)
