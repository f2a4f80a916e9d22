"""Directed graphs as edge tables: components, reachability, levels.

All of them are loops of joins whose state is written to the shared folder each round, so a lost executor costs no
finished round and no plan grows with the depth of the graph. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forgotten, written


def reached(edges: DataFrame, starts: DataFrame, depth: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., node, depth) of nodes reached from ``starts`` (keep..., node), with the first depth at which they are.

    Starts have depth 0 and are left out. A frontier holds only nodes seen for the first time, so cycles end. What was seen
    is added to in tables of doubling size, so each row is written a few times only, whatever the depth is.
    """
    keys = [*keep, "node"]
    step = written(edges.select(F.col("src").alias("node"), "dst").where("node <> dst").distinct())
    frontier = written(starts.select(*keys).distinct().withColumn("depth", F.lit(0)))
    parts, level = [(frontier, 1)], 0
    while depth is None or level < depth:
        level += 1
        fresh = frontier.join(step, "node").select(*keep, F.col("dst").alias("node")).distinct()
        for part, _ in parts:
            fresh = fresh.join(part, keys, "left_anti")
        frontier = written(fresh.withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        parts.append((frontier, 1))
        while len(parts) > 1 and parts[-1][1] == parts[-2][1]:
            (a, n), (b, m) = parts[-2:]
            parts[-2:] = [(written(a.unionByName(b)), n + m)]
    out = parts[0][0]
    for part, _ in parts[1:]:
        out = out.unionByName(part)
    return out.where("depth > 0")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that touch a node with no way in or no way out; what is left holds all cycles."""
    now = written(edges.where("src <> dst").select("src", "dst").distinct())
    n = now.count()
    while True:
        left = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        before, now = now, written(left)
        forgotten(before)
        m = now.count()
        if m == n:
            return now
        n = m


def followed(ways: DataFrame) -> DataFrame:
    """(node, to, n, low, going) of nodes with one way out (node, to): the first node on the way that isn't one of them, and the
    steps to it, by doubling. ``going`` are those whose way never ends; ``low`` is the smallest node so far passed.

    Where a round ends no way, none that ends is left: behind a longer one there would be a way of every smaller length.
    """
    inner = ways.select(F.col("node").alias("to"), F.lit(True).alias("going"))
    now = ways.join(inner, "to", "left").select("node", "to", F.lit(1).alias("n"), F.col("node").alias("low"), F.coalesce("going", F.lit(False)).alias("going"))
    now, before = written(now, "ways"), None
    while (n := now.where("going").count()) and n != before:
        before, last = n, now
        now = written(now.where("not going").unionByName(_doubled(now.where("going"), now)), "ways")
        forgotten(last)
    return now


def _doubled(rows: DataFrame, ways: DataFrame) -> DataFrame:
    on = ways.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"), F.col("low").alias("_low"), F.col("going").alias("_going"))
    return rows.select("node", "to", "n", "low").join(on, "to").select("node", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"), F.least("low", "_low").alias("low"), F.col("_going").alias("going"))


def _settled_by_following(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges without nodes whose one way out leads to an end or into a cycle of such nodes, and the (node, component) of these cycles."""
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ways"), F.min("dst").alias("to"))
    outs = written(outs, "outs")
    ways = outs.where("ways = 1").select("node", "to")
    if ways.isEmpty():
        return edges, None
    now = followed(ways)
    branching = outs.where("ways > 1").select("node")
    alive = branching.unionByName(now.where("not going").join(branching.withColumnRenamed("node", "to"), "to", "left_semi").select("node"))
    left = edges.join(alive.withColumnRenamed("node", "src"), "src", "left_semi").join(alive.withColumnRenamed("node", "dst"), "dst", "left_semi")
    ring = now.where("going")
    if ring.isEmpty():
        return left, None
    # nodes that are still met after ever more steps are the cycles; when no more drop out, all that do not lie on one have
    size, ring = None, ring.drop("n").withColumn("n", F.lit(0))
    while (met := ring.select("to").distinct().count()) != size:
        size, ring = met, written(_doubled(ring, ring), "rings")
    ring = written(ring.join(ring.select(F.col("to").alias("node")).distinct(), "node", "left_semi"), "rings")
    while True:
        further = _doubled(ring, ring).join(ring.select("node", F.col("low").alias("old")), "node")
        ring = written(further, "rings")
        if ring.where("low < old").isEmpty():
            return left, ring.select("node", F.col("low").alias("component"))
        ring = ring.drop("old")


def strongly_connected(edges: DataFrame, unroll: int = 3) -> DataFrame:
    """(node, component) of nodes on cycles; a component is named by its smallest node.

    Colouring: on the trimmed graph every node takes the smallest node that reaches it; nodes of a colour that also
    reach that node backwards form its component and leave; repeat with the rest. Each round takes at least one component
    away, so the loop ends by itself. Before that, nodes with one way out are followed by doubling: those that lead only into
    a cycle of such nodes, or to an end, are settled by it, however long their ways are.
    """
    left, out = _settled_by_following(written(edges.where("src <> dst").select("src", "dst").distinct()))
    left = trimmed(left)
    while not left.isEmpty():
        colour = written(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        while True:
            new = colour.withColumn("old", F.col("colour"))
            for _ in range(unroll):
                offered = left.join(new.select("node", "colour"), left["src"] == F.col("node")).groupBy("dst").agg(F.min("colour").alias("offer"))
                new = new.join(offered, new["node"] == offered["dst"], "left").select("node", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), "old")
            new = written(new)
            forgotten(colour)
            settled = new.where("colour < old").isEmpty()
            colour = new.drop("old")
            colour._written_to = new._written_to
            if settled:
                break
        same = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select(F.col("colour").alias("component"), "node")
        found = written(roots.unionByName(reached(back, roots, keep=("component",)).join(colour.select("node", "colour"), "node").where("component = colour").select("component", "node")).distinct())
        several = found.join(found.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("node", "component")
        out = several if out is None else out.unionByName(several)
        gone = found.select("node")
        before, left = left, trimmed(left.join(gone, left["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti"))
        forgotten(before)
    if out is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return written(out)


#: A layer is peeled off as long as it holds this share of the edges that are left.
PEELED = 1 / 8


def _peeled(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Layers of the edges (a, b, n) of a graph without cycles, and what is left: each layer's nodes ``a`` are above all that are
    left, so their levels follow from those. It ends where a layer holds few of the edges, as then the graph is deep and thin."""
    layers, rest = [], edges
    left = rest.count()
    while left:
        held = rest.select(F.col("b").alias("a")).distinct().withColumn("inner", F.lit(True))
        both = written(rest.join(held, "a", "left").select("a", "b", "n", F.col("inner").isNull().alias("top")), "peeled")
        before, left = left, both.where("not top").count()
        if before - left < before * PEELED:
            break
        layers.append(both.where("top").drop("top"))
        rest = both.where("not top").drop("top")
    return layers, rest


def _climbed(several: DataFrame, unroll: int) -> DataFrame:
    """(group, level) of the nodes of edges (a, b, n) that lead somewhere: only those whose longest chain grew go on."""
    level = written(several.select(F.explode(F.array("a", "b")).alias("group")).distinct().withColumn("level", F.lit(0)))
    frontier = level
    while True:
        # the highest level by a chain of each of the next numbers of dependencies, several a job
        steps, last = [], frontier
        for _ in range(unroll):
            last = several.join(last, several["b"] == last["group"]).groupBy("a").agg(F.max(F.col("level") + F.col("n")).alias("level")).withColumnRenamed("a", "group")
            steps.append(last)
        batch = steps[0].withColumn("at", F.lit(1))
        for k, s in enumerate(steps[1:], 2):
            batch = batch.unionByName(s.withColumn("at", F.lit(k)))
        batch = written(batch.groupBy("group").agg(F.max("level").alias("grown"), F.max(F.when(F.col("at") == unroll, F.col("level"))).alias("end")))
        if batch.isEmpty():
            return level.where("level > 0")
        level = written(level.join(batch.select("group", "grown"), "group", "left").select("group", F.greatest("level", "grown").alias("level")))
        # a chain that is lower than another to the same group adds nothing further on
        frontier = batch.where("end is not null").join(level, "group").where("end >= level").select("group", "level")


def longest_levels(edges: DataFrame, nodes: DataFrame, unroll: int = 4) -> DataFrame:
    """(node, level), see ``grouped_levels``."""
    return grouped_levels(edges, nodes, unroll).select("node", "level")


def grouped_levels(edges: DataFrame, nodes: DataFrame, unroll: int = 4) -> DataFrame:
    """(node, group, level) on the condensed graph: what depends on nothing is 0, else one more than the highest dependency.

    ``group`` is the smallest node of the cycles that a node is on, or itself.

    Groups with one dependency are followed by doubling to the next with none or several. Of these, layers that nothing left
    depends on are peeled off as long as they hold a share of the edges, and take their levels last, each edge once. Of the rest a
    group keeps the longest chain found so far, and only those whose chain grew go on; the condensed graph has no cycle, so the rounds end.
    """
    comp = strongly_connected(edges)
    group = written(nodes.select("node").distinct().join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("group")))
    between = edges.join(group.select(F.col("node").alias("src"), F.col("group").alias("a")), "src").join(group.select(F.col("node").alias("dst"), F.col("group").alias("b")), "dst")
    between = written(between.where("a <> b").select("a", "b").distinct())
    # a group with one dependency is as many levels above the next that has none or several as there are steps to it
    outs = written(between.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("ways"), F.min("b").alias("to")), "outs")
    below = followed(outs.where("ways = 1").select("node", "to")).select(F.col("node").alias("b"), "to", "n")
    several = between.join(outs.where("ways > 1").select(F.col("node").alias("a")), "a", "left_semi").join(below, "b", "left")
    several = several.groupBy("a", F.coalesce("to", "b").alias("b")).agg(F.max(F.coalesce("n", F.lit(0)) + 1).alias("n"))
    several = written(several)
    layers, several = _peeled(several)
    high = None if several.isEmpty() else _climbed(several, unroll)
    # from the lowest layer up, each edge is used once; tables of doubling size, so each level is written a few times only
    parts = [] if high is None else [(high, high.count())]
    for layer in reversed(layers):
        known = None
        for part, _ in parts:
            known = part if known is None else known.unionByName(part)
        met = layer.withColumn("level", F.lit(0)) if known is None else layer.join(known.withColumnRenamed("group", "b"), "b", "left")
        found = written(met.groupBy(F.col("a").alias("group")).agg(F.max(F.coalesce("level", F.lit(0)) + F.col("n")).alias("level")), "levels")
        parts.append((found, found.count()))
        while len(parts) > 1 and parts[-1][1] >= parts[-2][1]:
            (a, n), (b, m) = parts[-2:]
            parts[-2:] = [(written(a.unionByName(b), "levels"), n + m)]
    level = group.select("group").distinct().join(below.select(F.col("b").alias("group")), "group", "left_anti")
    high = None
    for part, _ in parts:
        high = part if high is None else high.unionByName(part)
    level = level.withColumn("level", F.lit(0)) if high is None else level.join(high, "group", "left").select("group", F.coalesce("level", F.lit(0)).alias("level"))
    level = written(level, "levels")
    met = group.join(below.select(F.col("b").alias("group"), F.col("to").alias("_to"), "n"), "group", "left").withColumn("_to", F.coalesce("_to", "group"))
    return met.join(level.withColumnRenamed("group", "_to"), "_to").select("node", "group", (F.col("level") + F.coalesce("n", F.lit(0))).alias("level"))
