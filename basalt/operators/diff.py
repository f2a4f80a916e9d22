"""Comparing two versions of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """(key, status, old, new) of rows that were added (A), deleted (D) or changed in a ``watched`` column (M).

    One full outer join; ``old`` and ``new`` are the whole rows, null on the side that lacks the key.
    """
    a = old.select(F.col(key).alias("_a"), F.struct(*old.columns).alias("old"))
    b = new.select(F.col(key).alias("_b"), F.struct(*new.columns).alias("new"))
    same = F.lit(True)
    for c in watched:
        same = same & F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    status = F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "D").when(~same, "M")
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    return joined.select(F.coalesce("_a", "_b").alias(key), status.alias("status"), "old", "new")
