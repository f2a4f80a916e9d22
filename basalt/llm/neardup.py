"""Near copies at a similarity of 0.8 of five-word shingles: groups, and one row of each.

SimHash links by Golay keys draw near copies together first; every link is confirmed by the exact similarity. SimHash
reaches no fixed similarity without loss: at 0.8 fingerprints differ in about ten bits of 64, far beyond what fuzzy keys
find. So the inverted lists of bottom-k sketches, see ``sketches``, find what these links leave apart; of the pairs they
find, too, the whole sets are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .sketches import grouped


def similar_documents(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """(doc_id, text_hash, digest, group, component_id) of every row.

    ``digest`` names its set of shingles, ``text_hash`` its text, ``group`` the rows reachable over similar pairs, and
    ``component_id`` is their smallest doc_id. Null and empty texts have the empty set and are one group; repeated rows are
    kept; null ids are kept and take part, but name a component only where all its ids are null; very long texts are read
    whole; an empty table gives no rows; other columns are ignored. ``options`` are those of ``grouped``.
    """
    marked, groups = grouped(docs, percent, **{"fuzzy": True, "small": 2_000} | options)
    named = groups.join(groups.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("digest", "group", "component_id")
    return marked.select("doc_id", "text_hash", "digest").join(named, "digest").select("doc_id", "text_hash", "digest", "group", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text`` and others), one of each group of ``similar_documents``, with all columns.

    The row with the smallest id stays (rows without id come last), of equal ids the one with the smallest hash of its
    text, of rows that agree in both the smallest by all columns; so reruns agree. Rows of one id with different texts are
    judged each on its own.
    """
    found = stored(similar_documents(docs, **options), "groups")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("b")).select("b.doc_id", "b.text_hash")
    again = found.join(best, found["doc_id"].eqNullSafe(best["doc_id"]) & (found["text_hash"] == best["text_hash"]), "left_semi").groupBy("doc_id", "text_hash").count()
    best = stored(again.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (F.col("count") > 1).alias("_again")), "best")
    rows = docs.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    kept = rows.join(best, rows["doc_id"].cast("long").eqNullSafe(best["_id"]) & (F.col("_text") == F.col("_hash")))
    out = kept.where(~F.col("_again")).select(*docs.columns)
    if best.where("_again").isEmpty():
        return out
    least = kept.where("_again").groupBy("_id", "_hash").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return out.unionByName(least)
