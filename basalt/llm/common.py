"""Helpers that several operators share: reading, durable intermediates, sizes checked before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

#: Fixed pattern of the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and survives lost executors."""
    return written(df, label)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on Python gets ``rows`` rows a batch, fewer than Spark's default, as rows hold long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def only(columns: list[str], *added: str) -> list[str]:
    """``columns`` without those named like an added one, which replaces them."""
    return [c for c in columns if c.lower() not in added]


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` only when its counted ``rows`` stay within ``limit``; otherwise a shuffled join is planned."""
    return F.broadcast(df) if rows <= limit else df


def crc32_mod(column: str, n: int):
    """The folds of the contracts: crc32 of the id as text, modulo ``n`` (null ids count as fold 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))
