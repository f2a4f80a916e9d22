"""Queries over graphs: cycles, dependents, levels, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import longest_levels, reached, strongly_connected
from ..sources.shared import written
from .base import Registry, table
from .facts import EDGES, degrees, nation_edges, nations

R = Registry()

_PARTS = "g AS (SELECT p_partkey AS src, (p_partkey * p_partkey + p_size) % (SELECT count(*) FROM part) AS dst FROM part), e AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst)"
_CLOSURE = f"WITH RECURSIVE {_PARTS}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)"
_SCC = f"{_CLOSURE}, scc AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = part.count()
    edges = part.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * F.col("p_partkey") + F.col("p_size")) % F.lit(n)).alias("dst"))
    return edges.where("src <> dst")


@R.add(f"{_SCC} SELECT component, CAST(count(*) AS BIGINT) AS members, array_to_string(list_sort(list(node)), ',') AS nodes FROM scc GROUP BY component")
def q34_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strongly_connected(part_edges(spark, sf_dir))
    return found.groupBy("component").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes"))


@R.add(f"""WITH RECURSIVE {_PARTS}, d AS (SELECT src AS node, 1 AS depth FROM e WHERE dst IN (0, 1, 2) UNION SELECT e.src, d.depth + 1 FROM d JOIN e ON e.dst = d.node WHERE d.depth < 5)
SELECT node, min(depth) AS depth FROM d WHERE node NOT IN (0, 1, 2) GROUP BY node""")
def q35_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = part_edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reached(back, spark.createDataFrame([(0,), (1,), (2,)], "node long"), depth=5)


@R.add(f"""WITH RECURSIVE {EDGES}, n AS (SELECT DISTINCT a.n_regionkey AS src, b.n_regionkey AS dst FROM edges JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey AND imports > 0),
d AS (SELECT src AS node, 1 AS depth FROM n WHERE dst = 0 UNION SELECT n.src, d.depth + 1 FROM d JOIN n ON n.dst = d.node WHERE d.depth < 5) SELECT node, min(depth) AS depth FROM d WHERE node <> 0 GROUP BY node""")
def q36_region_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    edges = nation_edges(spark, sf_dir).where("imports > 0").join(nation.toDF("src", "a"), "src").join(nation.toDF("dst", "b"), "dst").select(F.col("b").alias("src"), F.col("a").alias("dst"))
    return reached(edges, spark.createDataFrame([(0,)], "node int"), depth=5)


_DEG = "deg AS (SELECT n_nationkey AS node, (SELECT count(*) FROM edges WHERE dst = n_nationkey AND imports > 20) AS i, (SELECT count(*) FROM edges WHERE src = n_nationkey AND imports > 20) AS o FROM nation)"


@R.add(f"WITH {EDGES}, {_DEG} SELECT node, CASE WHEN i = 0 AND o = 0 THEN 'isolated' WHEN o = 0 THEN 'infra' WHEN i = 0 THEN 'entry' ELSE 'domain' END AS layer FROM deg")
def q37_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = degrees(nation_edges(spark, sf_dir).where("imports > 20"), nations(spark, sf_dir))
    i, o = F.col("in_degree"), F.col("out_degree")
    return deg.select("node", F.when((i == 0) & (o == 0), "isolated").when(o == 0, "infra").when(i == 0, "entry").otherwise("domain").alias("layer"))


@R.add(f"""{_SCC}, grp AS (SELECT p_partkey AS node, coalesce(component, p_partkey) AS grp FROM part LEFT JOIN scc ON scc.node = p_partkey), ge AS (SELECT DISTINCT a.grp AS a, b.grp AS b FROM e JOIN grp a ON a.node = src JOIN grp b ON b.node = dst WHERE a.grp <> b.grp),
lv AS (SELECT DISTINCT grp, 0 AS level FROM grp UNION SELECT ge.a, lv.level + 1 FROM lv JOIN ge ON ge.b = lv.grp) SELECT node, CAST(max(level) AS INTEGER) AS level FROM grp JOIN lv USING (grp) GROUP BY node""")
def q38_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_levels(part_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@R.add(f"""WITH RECURSIVE {_PARTS}, d AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey NOT IN (SELECT dst FROM e) UNION SELECT e.dst, d.depth + 1 FROM d JOIN e ON e.src = d.node WHERE d.depth < 200)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM d GROUP BY node HAVING min(depth) > 0""")
def q39_route_from_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = written(part_edges(spark, sf_dir))
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")).join(edges.select(F.col("dst").alias("node")), "node", "left_anti")
    return reached(edges, entries)


@R.add(f"""WITH {EDGES}, d AS (SELECT n_nationkey AS node, (SELECT count(*) FROM edges WHERE dst = n_nationkey) + (SELECT count(*) FROM edges WHERE src = n_nationkey) AS degree FROM nation)
SELECT node, CAST(degree AS BIGINT) AS degree, CAST((SELECT count(*) FROM nation) - 10 AS BIGINT) AS truncated FROM d ORDER BY degree DESC, node LIMIT 10""")
def q40_capped_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = degrees(nation_edges(spark, sf_dir), nations(spark, sf_dir)).select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    total = deg.agg((F.count("*") - 10).alias("truncated"))
    return deg.orderBy(F.desc("degree"), "node").limit(10).crossJoin(F.broadcast(total))
