"""Call trees of many definitions at once: who calls them, or whom they call, level by level under a budget for each root.

A tree isn't deduplicated: a definition stands under each of its callers. What bounds it is the depth and the number of
nodes a root may have; a level that would exceed that keeps the first of its rank, so no level holds more than the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import has_entry_name, is_test
from ..sources.shared import written

#: Nodes of a tree, and levels below its root.
MOST_NODES, MOST_DEPTH = 300, 3


def call_sites(facts: DataFrame, references: DataFrame) -> DataFrame:
    """(file, holder, outcome, target_file, target_ord, n): calls by the definition around them (none: the module) and what they reach.

    ``outcome`` is def for classes and functions of the tree, external, or unresolved (also calls of other values).
    """
    calls = facts.where("fact = 'call'").select("file", (F.col("ord") - 1).alias("ord"))
    callable_ = facts.where("fact = 'def' and kind in ('class', 'function', 'method', 'constructor')").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), F.lit(True).alias("known"))
    met = references.select("file", "ord", "holder", "outcome", "target_file", "target_ord").join(calls, ["file", "ord"], "left_semi").join(callable_, ["target_file", "target_ord"], "left")
    outcome = F.when(F.col("known"), "def").when(F.col("outcome") == "external", "external").otherwise("unresolved")
    place = lambda c: F.when(F.col("known"), F.col(c)).alias(c)
    return met.groupBy("file", "holder", outcome.alias("outcome"), place("target_file"), place("target_ord")).agg(F.count("*").alias("n"))


def call_tree(facts: DataFrame, references: DataFrame, roots: DataFrame, direction: str = "out", depth: int = 1, most: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """Trees below ``roots`` (file, ord), ``direction`` in (callers) or out (callees), as nodes and as one row a root.

    Nodes: (root_file, root_ord, level, place, parent, file, ord, name, kind, calls, is_entry, is_test); the root has level
    and place 0, ``parent`` is the place of the one above. Of a level the nodes come by their parent's place, then most
    calls first; a call of itself is no node. A module that calls has no ord and no callers. Roots: (root_file, root_ord,
    nodes, truncated, resolved, external, unresolved): ``truncated`` tells that the budget left some out, the others count
    the calls at the places that were expanded; calls that lead nowhere are known for callees only.
    """
    depth = max(1, min(depth, MOST_DEPTH))
    sites = written(call_sites(facts, references), "calls")
    known = sites.where("outcome = 'def' and not (file = target_file and coalesce(holder, -1) = target_ord)")
    if direction == "in":
        step = known.select(F.col("target_file").alias("file"), F.col("target_ord").alias("ord"), F.col("file").alias("to_file"), F.col("holder").alias("to_ord"), F.col("n").alias("calls"))
    else:
        step = known.where("holder is not null").select("file", F.col("holder").alias("ord"), F.col("target_file").alias("to_file"), F.col("target_ord").alias("to_ord"), F.col("n").alias("calls"))
    root = ["root_file", "root_ord"]
    level = written(roots.select(F.col("file").alias("root_file"), F.col("ord").alias("root_ord")).distinct().select(*root, F.lit(0).alias("level"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("parent"), F.col("root_file").alias("file"), F.col("root_ord").alias("ord"), F.lit(0).cast("long").alias("calls"), F.lit(False).alias("cut")), "tree")
    levels, taken = [level], level.select(*root, F.lit(0).alias("used"))
    for k in range(1, depth + 1):
        below = level.where("ord is not null").select(*root, F.col("place").alias("parent"), "file", "ord").join(step, ["file", "ord"])
        order = Window.partitionBy(*root).orderBy("parent", F.desc("calls"), "to_file", F.coalesce("to_ord", F.lit(-1)))
        # one row beyond the budget tells that there were more
        ranked = below.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most + 1).join(taken, root)
        kept = ranked.where(F.col("used") + F.col("rank") <= most + 1)
        level = kept.select(*root, F.lit(k).alias("level"), (F.col("used") + F.col("rank")).alias("place"), "parent", F.col("to_file").alias("file"), F.col("to_ord").alias("ord"), "calls", (F.col("used") + F.col("rank") > most).alias("cut"))
        level = written(level, "tree")
        levels.append(level)
        level = level.where("not cut")
        taken = taken.join(level.groupBy(*root).count(), root, "left").select(*root, (F.col("used") + F.coalesce("count", F.lit(0))).cast("int").alias("used"))
    every = levels[0]
    for other in levels[1:]:
        every = every.unionByName(other)
    named = facts.where("fact = 'def'").select("file", "ord", "name", "kind")
    nodes = every.where("not cut").join(named, ["file", "ord"], "left").withColumns({"name": F.coalesce("name", F.lit("<module>")), "kind": F.coalesce("kind", F.lit("module"))})
    nodes = nodes.select(*root, "level", "place", "parent", "file", "ord", "name", "kind", "calls", has_entry_name(F.col("file")).alias("is_entry"), is_test(F.col("file")).alias("is_test"))
    expanded = every.where((F.col("level") < depth) & ~F.col("cut") & F.col("ord").isNotNull()).select(*root, "file", "ord")
    by = ("target_file", "target_ord") if direction == "in" else ("file", "holder")
    seen = sites.where("outcome = 'def' and not (file = target_file and coalesce(holder, -1) = target_ord)" if direction == "in" else "holder is not null and (outcome <> 'def' or not (file = target_file and holder = target_ord))")
    told = seen.select(F.col(by[0]).alias("file"), F.col(by[1]).alias("ord"), "outcome", "n").groupBy("file", "ord").agg(*[F.sum(F.when(F.col("outcome") == o, F.col("n")).otherwise(0)).alias(c) for o, c in (("def", "resolved"), ("external", "external"), ("unresolved", "unresolved"))])
    covered = expanded.join(told, ["file", "ord"]).groupBy(*root).agg(*[F.sum(c).alias(c) for c in ("resolved", "external", "unresolved")])
    counted = every.groupBy(*root).agg(F.count_if((F.col("level") > 0) & ~F.col("cut")).alias("nodes"), F.max("cut").alias("truncated"))
    summary = counted.join(covered, root, "left").select(*root, "nodes", "truncated", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("resolved", "external", "unresolved")])
    return nodes, summary
