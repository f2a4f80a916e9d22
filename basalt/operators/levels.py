"""The dependency graph with folders and files side by side: each file stands for itself or for a folder, edges are rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname
from ..sources.shared import written

#: Files and folders that a graph has at most.
FILES, DIRS = 400, 200


def shown_as(files: DataFrame, expanded: DataFrame, focus: DataFrame | None = None, level: str = "dir", nested: bool = False) -> DataFrame:
    """(file, node, kind): what each file (``file``) is shown as.

    A file whose folder is in ``expanded`` (dir), a file of ``focus`` (file) and, at ``level`` file, every file is itself.
    Any other is its own folder; with ``nested``, the outermost folder around it that isn't expanded, so that a graph can be
    opened from the root (the empty name) down: the longest prefix of expanded folders, and one step more.
    """
    steps = F.concat(F.array(F.lit("")), ancestors(F.col("file")))
    each = files.select("file").distinct().select("file", F.posexplode(steps).alias("depth", "dir"))
    opened = expanded.select("dir").distinct().withColumn("open", F.lit(True))
    met = each.join(opened, "dir", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    told = met.groupBy("file").agg(F.max_by("open", "depth").alias("own"), F.max_by("dir", "depth").alias("dir"), F.min_by("dir", F.when(~F.col("open"), F.col("depth"))).alias("closed"))
    if focus is not None:
        told = told.join(focus.select("file").distinct().withColumn("focus", F.lit(True)), "file", "left")
    else:
        told = told.withColumn("focus", F.lit(None).cast("boolean"))
    itself = F.lit(level == "file") | F.coalesce("focus", F.lit(False)) | (F.col("closed").isNull() if nested else F.col("own"))
    return told.select("file", F.when(itself, F.col("file")).otherwise(F.col("closed") if nested else F.col("dir")).alias("node"), F.when(itself, "file").otherwise("dir").alias("kind"))


def level_graph(edges: DataFrame, files: DataFrame, expanded: DataFrame, focus: DataFrame | None = None, level: str = "dir", nested: bool = False, outside: DataFrame | None = None, external: int = 0, most_files: int = FILES, most_dirs: int = DIRS) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, kind, depth, files, inbound, outbound) and edges (src, src_kind, dst, dst_kind, imports, refs) of files' ``edges``.

    Without ``nested`` every folder is a node, with the files directly in it. ``inbound`` and ``outbound`` count edges of
    the graph. ``outside`` (file, package) are imports from beyond the tree, of which the ``external`` most used packages
    become nodes. Of more than ``most_files`` files or ``most_dirs`` folders those with most edges (files) or most files
    (folders) are kept, then by name, and the edges between kept nodes.
    """
    shown = written(shown_as(files, expanded, focus, level, nested), "shown")
    end = lambda side: shown.select(F.col("file").alias(side), F.col("node").alias(f"{side}_node"), F.col("kind").alias(f"{side}_kind"))
    met = edges.join(end("src"), "src").join(end("dst"), "dst").where("src_node <> dst_node or src_kind <> dst_kind")
    rolled = met.groupBy(F.col("src_node").alias("src"), "src_kind", F.col("dst_node").alias("dst"), "dst_kind").agg(F.sum("imports").alias("imports"), F.sum("refs").alias("refs"))
    own = shown.where("kind = 'file'").select("node", "kind", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("files"))
    depth = F.when(F.col("node") == "", 0).otherwise(F.size(F.split("node", "/")))
    if nested:
        dirs = shown.where("kind = 'dir'").groupBy("node").agg(F.count("*").alias("files"))
    else:
        every = files.select(F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("file")))).alias("node"), dirname(F.col("file")).alias("own"))
        dirs = every.groupBy("node").agg(F.count_if(F.col("node") == F.col("own")).alias("files"))
    nodes = own.unionByName(dirs.select("node", F.lit("dir").alias("kind"), depth.alias("depth"), "files"))
    if outside is not None and external > 0:
        used = outside.groupBy("package").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n")).orderBy(F.desc("files"), F.desc("n"), "package").limit(external)
        nodes = nodes.unionByName(used.select(F.col("package").alias("node"), F.lit("external").alias("kind"), F.lit(0).alias("depth"), "files"))
        brought = outside.join(F.broadcast(used.select("package")), "package").select("file", "package").distinct().join(shown, "file")
        rolled = rolled.unionByName(brought.groupBy(F.col("node").alias("src"), F.col("kind").alias("src_kind"), F.col("package").alias("dst"), F.lit("external").alias("dst_kind")).agg(F.count("*").alias("imports"), F.lit(0).cast("long").alias("refs")))
    rolled = written(rolled, "rolled")
    ends = rolled.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_kind").alias("kind"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.col("dst_kind").alias("kind"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    degree = ends.groupBy("e.node", "e.kind").agg(F.sum("e.i").alias("inbound"), F.sum("e.o").alias("outbound"))
    nodes = nodes.join(degree, ["node", "kind"], "left").select("node", "kind", "depth", "files", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("inbound", "outbound")])
    nodes = written(nodes, "nodes")
    # only where there are more than may be kept is there anything to sort
    number = {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()}
    if number.get("file", 0) <= most_files and number.get("dir", 0) <= most_dirs:
        return nodes, rolled.select("src", "src_kind", "dst", "dst_kind", "imports", "refs")
    first = nodes.where("kind = 'file'").orderBy(F.desc(F.col("inbound") + F.col("outbound")), "node").limit(most_files)
    widest = nodes.where("kind = 'dir'").orderBy(F.desc("files"), "node").limit(most_dirs)
    nodes = first.unionByName(widest).unionByName(nodes.where("kind = 'external'"))
    for side in ("src", "dst"):
        rolled = rolled.join(nodes.select(F.col("node").alias(side), F.col("kind").alias(f"{side}_kind")), [side, f"{side}_kind"], "left_semi")
    return nodes, rolled.select("src", "src_kind", "dst", "dst_kind", "imports", "refs")
