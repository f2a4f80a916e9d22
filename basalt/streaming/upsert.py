"""Facts of a tree kept up to date by batches of changes: only changed files are parsed, only their buckets are written anew.

A store is a folder of versions. Each version holds the buckets that its batch touched, and a manifest that names, for
every bucket, the version that has it now; a batch counts once its manifest is there, so a batch that is tried again, or
was half done when machines went, does no harm. Readers read the newest manifest's buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import ancestors
from ..sources.python_facts import SCHEMA, python_facts
from ..sources.shared import forgotten, written

ENTRIES = "rel string, size long, mtime timestamp"


class FactStore:
    """Versioned facts and entries below ``root``, dealt to ``buckets`` by the hash of the file."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _manifests(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()) for f in found or ())

    def version(self) -> int | None:
        done = self._manifests()
        return done[-1] if done else None

    def places(self) -> dict[int, int]:
        """Of each bucket that holds files, the version that has it."""
        now = self.version()
        return {} if now is None else {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.root}/manifest/{now}").collect()}

    def _read(self, what: str, schema: str, places: dict[int, int]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, bucket int")
        for version in sorted(set(places.values())):
            folder = f"{self.root}/v{version}/{what}"
            out = out.unionByName(self.spark.read.schema(f"{schema}, bucket int").option("basePath", folder).parquet(*[f"{folder}/bucket={b}" for b, v in sorted(places.items()) if v == version]))
        return out

    def facts(self) -> DataFrame:
        return self._read("facts", SCHEMA, self.places()).drop("bucket")

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRIES, self.places()).drop("bucket")

    def bucket(self, rel: str):
        return F.pmod(F.xxhash64(rel), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take over a batch (rel, change, text, size, mtime, ord), ``change`` being upsert or delete, in the order of ``ord``.

        Of several changes of a file the last counts. Deleting a folder deletes all files below it that weren't written
        later in the batch. A batch that the store has already is left out. Deletes read all entries, nothing else does.
        """
        if batch_id in self._manifests():
            return
        batch = written(batch.select("rel", "change", "text", F.col("size").cast("long").alias("size"), F.col("mtime").cast("timestamp").alias("mtime"), F.col("ord").cast("long").alias("ord")), "batch")
        places = self.places()
        last = batch.groupBy("rel").agg(F.max_by(F.struct("change", "text", "size", "mtime", "ord"), "ord").alias("b")).select("rel", "b.*")
        deletes = batch.where("change = 'delete'").groupBy(F.col("rel").alias("step")).agg(F.max("ord").alias("deleted"))
        steps = F.explode(F.concat(ancestors(F.col("rel")), F.array("rel")))
        upserts = last.where("change = 'upsert'")
        hit = upserts.select("rel", steps.alias("step"), "ord").join(deletes, "step").where("deleted > ord").select("rel").distinct()
        upserts = written(upserts.join(hit, "rel", "left_anti"), "upserts")
        changed = batch.select("rel")
        if not deletes.isEmpty() and places:
            gone = self._read("entries", ENTRIES, places).select("rel", steps.alias("step")).join(deletes, "step").select("rel")
            changed = changed.unionByName(gone)
        changed = written(changed.distinct().withColumn("bucket", self.bucket("rel")), "changed")
        touched = {r["bucket"] for r in changed.select("bucket").distinct().collect()}
        kept = {b: v for b, v in places.items() if b in touched}
        names = changed.select("rel")
        entries = self._read("entries", ENTRIES, kept).join(names, "rel", "left_anti")
        entries = entries.unionByName(upserts.select("rel", "size", "mtime").withColumn("bucket", self.bucket("rel")))
        facts = self._read("facts", SCHEMA, kept).join(names.withColumnRenamed("rel", "file"), "file", "left_anti")
        facts = facts.unionByName(python_facts(upserts.select("rel", "text", F.lit("python").alias("lang")).where("rel like '%.py' or rel like '%.pyi'")).withColumn("bucket", self.bucket("file")))
        for what, df in (("entries", entries), ("facts", facts)):
            df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v{batch_id}/{what}")
        # buckets without facts have no folder: those with a file but no fact get an empty one by reading with the schema
        have = {what: self._listed(batch_id, what) for what in ("entries", "facts")}
        self._settle(batch_id, {b: v for b, v in places.items() if b not in touched} | dict.fromkeys(have["entries"], batch_id), have["entries"] - have["facts"])
        for df in (batch, upserts, changed):
            forgotten(df)

    def _listed(self, version: int, what: str) -> set[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{version}/{what}/bucket=*")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return {int(f.getPath().getName().split("=")[1]) for f in found or ()}

    def _settle(self, version: int, places: dict[int, int], without_facts: set[int]) -> None:
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for b in without_facts:
            path = fs_path(f"{self.root}/v{version}/facts/bucket={b}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        rows = self.spark.createDataFrame([(b, v) for b, v in sorted(places.items())], "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version}")

    def compact(self, version: int) -> None:
        """All buckets in one new version, so that readers open few folders."""
        places = self.places()
        for what, schema in (("entries", ENTRIES), ("facts", SCHEMA)):
            self._read(what, schema, places).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v{version}/{what}")
        have = self._listed(version, "entries")
        self._settle(version, dict.fromkeys(have, version), have - self._listed(version, "facts"))

    def follow(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Apply a stream of changes, a micro-batch each."""
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def differences(self, scan: DataFrame) -> DataFrame:
        """(rel, status): what a scan (rel, size, mtime) has that the store's entries haven't, the other way round, or otherwise.

        ``status`` is added, changed or deleted; times are compared to the millisecond.
        """
        now = scan.select("rel", F.struct("size", F.unix_millis(F.round(F.col("mtime").cast("double"), 3).cast("timestamp")).alias("at")).alias("now"))
        known = self.entries().select("rel", F.struct("size", F.unix_millis(F.round(F.col("mtime").cast("double"), 3).cast("timestamp")).alias("at")).alias("known"))
        status = F.when(F.col("known").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("known"), "changed")
        return now.join(known, "rel", "full").select("rel", status.alias("status")).where("status is not null")

    def reconcile(self, scan: DataFrame, batch_id: int) -> DataFrame:
        """Bring the store to what a scan (rel, text, size, mtime) holds, also after new ignore rules; gives the differences."""
        found = written(self.differences(scan), "differences")
        changes = found.join(scan.select("rel", "text", "size", "mtime"), "rel", "left")
        self.apply(changes.select("rel", F.when(F.col("status") == "deleted", "delete").otherwise("upsert").alias("change"), "text", "size", "mtime", F.lit(0).cast("long").alias("ord")), batch_id)
        return found
