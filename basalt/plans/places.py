"""Questions about places, calls and levels, over the tree of Python files that ``code`` makes from the ``part`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calltree, codemap, levels, positions, routes, summaries
from .base import Registry, table
from .code import _DEGREE, _EDGES, edges_of, facts_of, file_of, key_of, known_of, linked_of, tree

R = Registry()

#: Columns at which the names of line 16 begin, for a file that imports from b and c.
_LINE = """q AS (SELECT p_partkey AS p, p_partkey // 2 AS b, p_partkey // 3 AS c, 6 + length(CAST(p_partkey // 2 AS VARCHAR)) AS l1, 6 + length(CAST(p_partkey // 3 AS VARCHAR)) AS l2 FROM part WHERE p_partkey > 0),
s AS (SELECT *, 22 + l1 AS f, 26 + l1 AS g, 27 + l1 + l2 AS e FROM q),
n AS (SELECT p, k.* FROM s, LATERAL (VALUES (16, 16 + l1, 'helper' || b, b, CASE WHEN b = 0 THEN 16 ELSE 19 END, 5), (17 + l1, 18 + l1, 'x', p, 15, 19), (f, f + 3, 'far', c, 1, 1), (g, g + l2, 'helper' || c, c, CASE WHEN c = 0 THEN 16 ELSE 19 END, 5), (e, e + 4, 'self', p, 15, 13), (e + 5, e + 9, 'size', p, 13, 14), (e + 13, e + 18, 'LIMIT', p, 6, 1)) AS k(a, z, symbol, target, line, col_))"""


def points_of(spark: SparkSession, sf_dir: str, lines: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """(file, line, col): every place of the generated files in these lines and columns."""
    files = tree(spark, sf_dir).select(F.col("rel").alias("file"))
    return files.withColumn("line", F.explode(F.sequence(F.lit(lines[0]), F.lit(lines[1])))).withColumn("col", F.explode(F.sequence(F.lit(cols[0]), F.lit(cols[1]))))


@R.add(f"""WITH {_LINE} SELECT q.p, CAST(u.c AS INTEGER) AS col, n.symbol, CASE WHEN n.p IS NULL THEN 'no-symbol' ELSE 'resolved' END AS reason, n.target, CAST(n.line AS INTEGER) AS target_line, CAST(n.col_ AS INTEGER) AS target_col
FROM q, LATERAL (SELECT unnest(range(8, 71)) AS c) AS u LEFT JOIN n ON n.p = q.p AND n.a <= u.c AND u.c <= n.z""")
def q78_goto_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at each column of the line with most names of each file, and where it is defined."""
    facts, known = known_of(spark, sf_dir, more=("name_line", "name_col"))
    points = points_of(spark, sf_dir, (16, 16), (8, 70)).where(~F.col("file").endswith("/mod0.py"))
    found = positions.definitions_at(points, facts, known.references, known.imports)
    return found.select(key_of(F.col("file")).alias("p"), F.col("at_col").alias("col"), "symbol", "reason", key_of(F.col("target_file")).alias("target"), "target_line", "target_col")


@R.add("""SELECT p_partkey AS p, CAST(u.n AS INTEGER) AS line, CASE WHEN m BETWEEN 12 AND 13 THEN '__init__' WHEN m BETWEEN 15 AND 16 THEN 'run' WHEN m BETWEEN 9 AND 16 THEN 'Thing' || p_partkey WHEN m BETWEEN 19 AND 22 THEN 'helper' || p_partkey ELSE 'twice' || p_partkey END AS name
FROM part, LATERAL (SELECT unnest(range(1, 41)) AS n) AS u, LATERAL (SELECT CASE WHEN p_partkey = 0 THEN u.n + 3 ELSE u.n END AS m) AS v WHERE m BETWEEN 9 AND 16 OR m BETWEEN 19 AND 22 OR m BETWEEN 25 AND 27""")
def q79_enclosing_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positions.around(points_of(spark, sf_dir, (1, 40), (9, 9)), facts_of(spark, sf_dir, "def"))
    return found.select(key_of(F.col("file")).alias("p"), F.col("at_line").alias("line"), "name")


@R.add("""WITH h AS (SELECT p_partkey AS k FROM part)
SELECT h.k AS p, p_partkey AS by, CAST(2 AS INTEGER) AS line, 'import' AS kind FROM h JOIN part ON p_partkey // 2 = h.k AND p_partkey > 0
UNION ALL SELECT DISTINCT h.k, p_partkey, 16, 'ref' FROM h JOIN part ON (p_partkey // 2 = h.k OR p_partkey // 3 = h.k) AND p_partkey > 0
UNION ALL SELECT k, k, CASE WHEN k = 0 THEN 24 ELSE 27 END, 'ref' FROM h""")
def q80_reference_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that means a helper: imports of it, uses in other files and in its own."""
    facts, known = known_of(spark, sf_dir)
    helpers = facts.where("fact = 'def' and kind = 'function' and name like 'helper%'").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"))
    found = positions.references_to(facts, known.references, known.imports).join(helpers, ["target_file", "target_ord"])
    return found.select(key_of(F.col("target_file")).alias("p"), key_of(F.col("file")).alias("by"), "line", "kind").distinct()


@R.add("""SELECT p_partkey AS p, CAST(CASE WHEN p_partkey = 0 THEN 4 WHEN p_partkey // 2 = p_partkey // 3 THEN 6 ELSE 8 END AS BIGINT) AS nodes, false AS truncated, CAST(CASE WHEN p_partkey = 0 THEN 4 WHEN p_partkey // 2 = p_partkey // 3 THEN 7 ELSE 8 END AS BIGINT) AS resolved, CAST(0 AS BIGINT) AS external,
CAST(CASE WHEN p_partkey = 0 THEN 1 WHEN p_partkey // 2 = p_partkey // 3 THEN 2 ELSE 3 END AS BIGINT) AS unresolved FROM part""")
def q81_call_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of what each ``twice`` calls: nodes, and how many calls lead where."""
    facts, known = known_of(spark, sf_dir)
    roots = facts.where("fact = 'def' and kind = 'function' and name like 'twice%'").select("file", "ord")
    _, summary = calltree.call_tree(facts, known.references, roots, "out", depth=3)
    return summary.select(key_of(F.col("root_file")).alias("p"), "nodes", "truncated", "resolved", "external", "unresolved")


@R.add("""WITH c AS (SELECT p_partkey AS k FROM part), d AS (SELECT c.k, p_partkey AS q FROM c JOIN part ON (p_partkey // 2 = c.k OR p_partkey // 3 = c.k) AND p_partkey > 0), n AS (SELECT k, count(*) AS n FROM d GROUP BY k)
SELECT c.k AS p, CAST(least(8, 1 + coalesce(n.n, 0) + coalesce((SELECT count(*) FROM d WHERE d.k = c.k), 0)) AS BIGINT) AS nodes, 1 + 2 * coalesce(n.n, 0) > 8 AS truncated FROM c LEFT JOIN n ON n.k = c.k""")
def q82_caller_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls each helper, two levels up, with at most 8 nodes a tree."""
    facts, known = known_of(spark, sf_dir)
    roots = facts.where("fact = 'def' and kind = 'function' and name like 'helper%'").select("file", "ord")
    _, summary = calltree.call_tree(facts, known.references, roots, "in", depth=2, most=8)
    return summary.select(key_of(F.col("root_file")).alias("p"), "nodes", "truncated")


_SHOWN = f"""{_EDGES}, w AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 7 IN (1, 3) THEN 'pkg' || (p_partkey % 7) || '/mod' || p_partkey || '.py' ELSE 'pkg' || (p_partkey % 7) END AS node FROM part),
g AS (SELECT a.node AS src, b.node AS dst, CAST(sum(imports) AS BIGINT) AS imports, CAST(sum(refs) AS BIGINT) AS refs FROM e JOIN w AS a ON a.p = e.src JOIN w AS b ON b.p = e.dst WHERE a.node <> b.node GROUP BY ALL)"""


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts, known = linked_of(spark, sf_dir)
    edges = edges_of(known)
    expanded = spark.createDataFrame([("pkg1",), ("pkg3",)], "dir string")
    files = facts.where("fact = 'scope' and parent is null").select("file")
    return levels.level_graph(edges, files, expanded, outside=codemap.outside_imports(known.imports), external=3, most_files=1 << 30, most_dirs=1 << 30)


@R.add(f"WITH {_SHOWN} SELECT * FROM g UNION ALL SELECT node, 'os', CAST(count(*) AS BIGINT), CAST(0 AS BIGINT) FROM w WHERE p > 0 GROUP BY node")
def q83_level_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph with two folders opened: their files beside the other folders, and the packages from outside."""
    return _levels(spark, sf_dir)[1].select("src", "dst", "imports", "refs")


@R.add(f"""WITH {_SHOWN}, a AS (SELECT src, dst FROM g UNION ALL SELECT DISTINCT node, 'os' FROM w WHERE p > 0), v AS (SELECT node, 'file' AS kind, 1 AS files FROM w WHERE node LIKE '%.py' UNION ALL SELECT 'pkg' || (p_partkey % 7), 'dir', count(*) FROM part GROUP BY 1 UNION ALL SELECT '', 'dir', 0 UNION ALL SELECT 'os', 'external', count(*) FROM part WHERE p_partkey > 0)
SELECT node, kind, CAST(files AS BIGINT) AS files, CAST((SELECT count(*) FROM a WHERE dst = node) AS BIGINT) AS inbound, CAST((SELECT count(*) FROM a WHERE src = node) AS BIGINT) AS outbound FROM v""")
def q84_level_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)[0].select("node", "kind", "files", "inbound", "outbound")


@R.add("""SELECT p_partkey AS p, CAST(CASE WHEN p_partkey = 0 THEN 18 ELSE 21 END AS INTEGER) AS line, 'run' AS name, 'dynamic-member' AS reason FROM part""")
def q94_unresolved_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, known = known_of(spark, sf_dir)
    return summaries.unresolved_reasons(facts, known.references, known.imports).select(key_of(F.col("file")).alias("p"), "line", "name", "reason")


@R.add(f"""WITH {_DEGREE} SELECT p, CAST(4 AS BIGINT) AS exports, '2 function, 1 class, 1 constant' AS kinds, CAST(CASE WHEN p = 0 THEN 0 ELSE 3 END AS BIGINT) AS project_imports, CAST(CASE WHEN p = 0 THEN 0 ELSE 1 END AS BIGINT) AS external_imports, inbound, CAST(0 AS BIGINT) AS inbound_tests, in_degree AS users, out_degree AS outbound, CAST(4 AS BIGINT) AS longest FROM d""")
def q95_file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, known = known_of(spark, sf_dir)
    found = summaries.file_summaries(facts, known.imports, codemap.file_edges(known.imports, known.references))
    return found.withColumn("p", key_of(F.col("file"))).drop("file")


@R.add(f"""WITH {_DEGREE}, n AS (SELECT d.p, 'pkg' || (d.p % 7) || '/mod' || d.p || '.py' AS file, CASE WHEN d.p = 0 THEN 0 ELSE floor(log2(d.p)) + 1 END AS level, in_degree, p_size FROM d JOIN part ON p_partkey = d.p),
r AS (SELECT 'dep' AS route, p, row_number() OVER (ORDER BY level, file) AS step FROM n UNION ALL SELECT 'entry', p, row_number() OVER (ORDER BY p <> 0, in_degree DESC, file) FROM n UNION ALL SELECT 'hot', p, row_number() OVER (ORDER BY in_degree DESC, file) FROM n UNION ALL SELECT 'fresh', p, row_number() OVER (ORDER BY p_size DESC, file) FROM n)
SELECT route, CAST(step AS INTEGER) AS step, p, CAST(CASE WHEN p = 0 THEN 3 ELSE 6 END AS INTEGER) AS line, 'LIMIT,Thing' || p || ',helper' || p AS hints, CAST((SELECT count(*) FROM part) AS INTEGER) AS total FROM r WHERE step <= 40""")
def q96_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four orders in which to read the generated tree; a file's time is made from its part's size."""
    facts, known = linked_of(spark, sf_dir, "line")
    part = table(spark, sf_dir, "part").select(file_of(F.col("p_partkey")).alias("file"), F.timestamp_seconds("p_size").alias("mtime"))
    degree = codemap.degrees(edges_of(known), facts.where("fact = 'scope' and parent is null").select("file"))
    found = routes.routes(facts, known.imports, degree, part)
    return found.select("route", "step", key_of(F.col("file")).alias("p"), "line", F.array_join("hints", ",").alias("hints"), F.col("total").cast("int").alias("total"))
