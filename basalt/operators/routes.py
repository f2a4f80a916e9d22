"""Orders in which to read a tree: dependencies first, from the entries down, most used first, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import has_entry_name, is_doc_or_config
from ..sources.shared import written
from .graph import grouped_levels

#: Steps of a route, and symbols named for a step.
MOST_STEPS, HINTS = 40, 3


def import_graph(imports: DataFrame) -> DataFrame:
    """(src, dst): which file imports which."""
    return imports.where("target_file is not null and file <> target_file").select(F.col("file").alias("src"), F.col("target_file").alias("dst")).distinct()


def _numbered(rows: DataFrame, *order, most: int = MOST_STEPS) -> DataFrame:
    """The first rows by an order, numbered from 1. Only those reach the one task that numbers them."""
    first = rows.orderBy(*order).limit(most)
    return first.withColumn("step", F.row_number().over(Window.partitionBy().orderBy(*order)))


def dependency_route(files: DataFrame, graph: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """(step, file, reason): what depends on nothing first, cycles together, by level and then by name."""
    levels = grouped_levels(graph, files.select(F.col("file").alias("node")))
    size = levels.groupBy("group").agg(F.count("*").alias("n"))
    needs = graph.select(F.col("src").alias("node")).distinct().withColumn("needs", F.lit(True))
    told = levels.join(size, "group").join(needs, "node", "left")
    reason = F.when(F.col("n") > 1, "in a cycle").when(F.col("needs"), "after what it needs").otherwise("needs nothing")
    return _numbered(told.select(F.col("node").alias("file"), "level", "group", reason.alias("reason")), "level", "group", "file", most=most).select("step", "file", "reason")


def entry_route(files: DataFrame, graph: DataFrame, in_degree: DataFrame, first: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """(step, file, reason): entries by use, then level by level what they import, then the rest by use.

    Of a level the children come in their first parent's order, those that import most first. Without an entry it starts
    at ``first`` (file). A level is cut to the steps that are left, as nothing beyond them is shown.
    """
    used = files.select("file").join(in_degree.select("file", "in_degree"), "file", "left").select("file", F.coalesce("in_degree", F.lit(0)).alias("used"))
    out_degree = graph.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("out"))
    entries = used.where(has_entry_name(F.col("file")))
    start = _numbered(entries, F.desc("used"), "file", most=most).select("step", "file", F.lit("entry").alias("reason"))
    frontier = written(start, "route")
    taken = frontier.count()
    if not taken:
        frontier = written(first.select(F.lit(1).alias("step"), "file", F.lit("first by dependencies").alias("reason")), "route")
        taken = frontier.count()
    out = frontier
    while taken < most:
        below = graph.join(frontier.select(F.col("file").alias("src"), F.col("step").alias("parent")), "src").join(out.select(F.col("file").alias("dst")), "dst", "left_anti").join(files.select(F.col("file").alias("dst")), "dst", "left_semi")
        nearest = below.groupBy(F.col("dst").alias("file")).agg(F.min("parent").alias("parent")).join(out_degree, "file", "left")
        level = _numbered(nearest.withColumn("out", F.coalesce("out", F.lit(0))), "parent", F.desc("out"), "file", most=most - taken)
        frontier = written(level.select((F.col("step") + taken).cast("int").alias("step"), "file", F.concat(F.lit("imported by step "), F.col("parent")).alias("reason")), "route")
        n = frontier.count()
        if not n:
            break
        taken += n
        out = out.unionByName(frontier)
    if taken >= most:
        return out
    reason = F.when(F.col("used") > 0, F.concat(F.lit("used by "), F.col("used"))).otherwise("not used")
    rest = _numbered(used.join(out.select("file"), "file", "left_anti"), F.desc("used"), "file", most=most - taken)
    return out.unionByName(rest.select((F.col("step") + taken).cast("int").alias("step"), "file", reason.alias("reason")))


def routes(facts: DataFrame, imports: DataFrame, degree: DataFrame, times: DataFrame | None = None, most: int = MOST_STEPS) -> DataFrame:
    """(route, step, file, reason, line, hints, total, truncated): the four routes, of ``most`` steps at most.

    ``degree`` has in_degree of each file, ``times`` (file, mtime) when files were changed. Documents and settings are left
    out. ``hints`` names the first three definitions at the top of a file, ``line`` is that of the first, or 1.
    """
    files = written(facts.where("fact = 'scope' and parent is null").select("file").where(~is_doc_or_config(F.col("file"))), "files")
    graph = written(import_graph(imports), "imports")
    total = files.count()
    dep = written(dependency_route(files, graph, most), "dep")
    entry = entry_route(files, graph, degree, dep.where("step = 1").select("file"), most)
    used = files.join(degree.select("file", "in_degree"), "file", "left").select("file", F.coalesce("in_degree", F.lit(0)).alias("used"))
    hot = _numbered(used, F.desc("used"), "file", most=most).select("step", "file", F.when(F.col("used") > 0, F.concat(F.lit("used by "), F.col("used"))).otherwise("not used").alias("reason"))
    every = dep.withColumn("route", F.lit("dep")).unionByName(entry.withColumn("route", F.lit("entry"))).unionByName(hot.withColumn("route", F.lit("hot")))
    if times is not None:
        fresh = _numbered(files.join(times.select("file", "mtime"), "file", "left"), F.desc_nulls_last("mtime"), "file", most=most)
        every = every.unionByName(fresh.select("step", "file", F.coalesce(F.date_format("mtime", "yyyy-MM-dd"), F.lit("unknown")).alias("reason"), F.lit("fresh").alias("route")))
    top = facts.where("fact = 'def' and kind <> 'property' and binds").where(F.col("scope") == F.concat("file", F.lit("#0"))).join(every.select("file").distinct(), "file", "left_semi")
    first = top.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("line", "ord"))).where(F.col("r") <= HINTS)
    hints = first.groupBy("file").agg(F.min("line").alias("line"), F.transform(F.array_sort(F.collect_list(F.struct("line", "ord", "name"))), lambda h: h["name"]).alias("hints"))
    out = every.join(hints, "file", "left").withColumns({"line": F.coalesce("line", F.lit(1)), "hints": F.coalesce("hints", F.array().cast("array<string>")), "total": F.lit(total), "truncated": F.lit(total > most)})
    return out.select("route", "step", "file", "reason", "line", "hints", "total", "truncated")
