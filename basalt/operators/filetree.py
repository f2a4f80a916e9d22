"""File trees: folders with the files below them, and chains of folders that hold nothing but one folder drawn as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname
from ..sources.shared import forgotten, written


def visible(files: DataFrame, term: str = "", only: DataFrame | None = None) -> DataFrame:
    """Files (``file``) whose path holds a term, in any case, and that are among ``only`` (file), as far as these are given."""
    if term:
        files = files.where(F.contains(F.lower("file"), F.lit(term.lower())))
    return files if only is None else files.join(only.select("file").distinct(), "file", "left_semi")


def chain_ends(folders: DataFrame) -> DataFrame:
    """(dir, end) of ``folders`` (dir, only): the last folder of the chain that begins at each, ``only`` being its single child folder or null.

    Pointer jumping: each round every folder points to what its pointer points to, so a chain of n takes log n rounds.
    """
    now = written(folders.select("dir", F.coalesce("only", "dir").alias("end")), "chains")
    moved = folders.where("only is not null").count()
    while moved:
        step = now.join(now.select(F.col("dir").alias("end"), F.col("end").alias("next")), "end").select("dir", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved"))
        before, now = now, written(step, "chains")
        moved = now.where("moved").count()
        forgotten(before)
    return now.select("dir", "end")


def compacted(files: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(parent, path, name, kind, files, ignored, place): the tree of ``files`` (file) with single-child folders drawn as one.

    A folder that holds one folder and nothing else is drawn with it, as one name with slashes; ``path`` is the last folder
    of such a chain and ``parent`` the drawn folder it is in, the root being empty and never part of a chain. ``files``
    counts those below. ``place`` orders the entries of a folder: folders first, what is in ``ignored`` (path) last of its
    kind, then by name in any case.
    """
    folders = files.select(F.explode(ancestors(F.col("file"))).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))
    folders = written(folders, "folders")
    kids = folders.select(dirname(F.col("dir")).alias("up"), F.col("dir").alias("kid"), F.lit(1).alias("is_dir")).unionByName(files.select(dirname(F.col("file")).alias("up"), F.col("file").alias("kid"), F.lit(0).alias("is_dir")).distinct())
    single = kids.where("up <> ''").groupBy("up").agg(F.count("*").alias("n"), F.sum("is_dir").alias("dirs"), F.min("kid").alias("kid")).where("n = 1 and dirs = 1").select(F.col("up").alias("dir"), F.col("kid").alias("only"))
    ends = chain_ends(folders.select("dir").join(single, "dir", "left"))
    # a chain begins at a folder that isn't drawn with the one above
    inner = single.select(F.col("only").alias("dir"))
    heads = ends.join(inner, "dir", "left_anti")
    drawn = heads.join(folders.select(F.col("dir").alias("end"), "files"), "end").select(dirname(F.col("dir")).alias("up"), F.col("dir").alias("head"), F.col("end").alias("path"), F.lit("dir").alias("kind"), "files")
    every = drawn.unionByName(files.select(dirname(F.col("file")).alias("up"), F.col("file").alias("head"), F.col("file").alias("path"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("files")).distinct())
    out = every.select(F.col("up").alias("parent"), "path", F.when(F.col("up") == "", F.col("path")).otherwise(F.substring("path", F.char_length("up") + 2, F.char_length("path"))).alias("name"), "kind", "files")
    if ignored is None:
        out = out.withColumn("ignored", F.lit(False))
    else:
        out = out.join(ignored.select("path", F.lit(True).alias("ignored")).distinct(), "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
    return out.select("parent", "path", "name", "kind", "files", "ignored", F.struct((F.col("kind") != "dir").alias("file"), "ignored", F.lower("name").alias("folded"), "name").alias("place"))
