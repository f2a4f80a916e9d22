"""Code questions, answered over a tree of Python files that is made from the ``part`` table.

The driver's tables hold no source code, so every part p is written out as a small module: it imports from the modules of
p // 2 and p // 3, extends a class, and calls functions of both. The files go through the same parser, resolution and
graph operators as any tree; what comes out must equal what plain arithmetic on the keys gives, which is the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codemap
from ..operators.graph import longest_levels, reached, strongly_connected
from ..operators.resolve import Resolved, resolve_imports, resolved
from ..sources.python_facts import python_facts
from ..sources.shared import written
from .base import Registry, table

R = Registry()

_IMPORTS = """from pkg{bd}.mod{b} import Thing{b} as Other, helper{b}
import pkg{cd}.mod{c} as far
import os.path
"""
_BODY = """
LIMIT = {size}


class Thing{p}{base}:
    \"\"\"Thing number {p}.\"\"\"

    def __init__(self, size):
        self.size = size

    def run(self, x):
        return {expression}


def helper{p}(x):
    if x:
        return Thing{p}(x).run(LIMIT)
    return x


def twice{p}(x):
    one = Thing{p}(x)
    return one.run(x) + helper{p}(x)
"""


def _dir(key):
    return (key % 7).cast("string")


#: Files that one task parses.
FILES_A_TASK = 4000
#: Facts and columns that names are resolved by.
RESOLVED = ("scope", "def", "ref", "import", "base", "call", "argument")
COLUMNS = (
    "file", "fact", "scope", "parent", "body", "kind", "name", "module", "imported", "parts", "type_name", "text", "line", "col", "end_line", "end_col",
    "ord", "owner", "binds", "found", "found_ord", "stars", "holder", "of", "place",
    "settled", "settled_body", "alone", "inner",
)
#: Columns by which names that reach beyond their files are resolved.
OF_LINKS = (
    "file", "fact", "scope", "parent", "body", "kind", "name", "module", "imported", "parts", "type_name", "ord", "owner", "binds", "found", "found_ord", "stars", "of", "place",
    "settled", "settled_body", "alone", "inner",
)
#: Columns that imports alone are resolved by.
OF_IMPORTS = ("file", "fact", "scope", "parent", "kind", "name", "module", "imported", "ord", "binds")


def tree(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """(rel, text, lang): one file for each part; the part of key 0, or the smallest keys' own base, imports nothing.

    ``spread`` deals the keys, before the texts are made, to as many tasks as the number of files asks for.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), "p_size")
    if spread:
        part = part.repartition(max(spark.sparkContext.defaultParallelism, -(-part.count() // FILES_A_TASK)), "p")
    b, c = F.floor(F.col("p") / 2).cast("long"), F.floor(F.col("p") / 3).cast("long")
    text = lambda template, **values: _filled(F.lit(template), values)
    imports = text(_IMPORTS, b=b, c=c, bd=_dir(b), cd=_dir(c))
    uses = F.concat(F.lit("helper"), b.cast("string"), F.lit("(x) + far.helper"), c.cast("string"), F.lit("(self.size) + LIMIT"))
    roots = F.col("p") < 1
    body = text(_BODY, p=F.col("p"), size=F.col("p_size"), base=F.when(roots, "").otherwise("(Other)"), expression=F.when(roots, "self.size + LIMIT").otherwise(uses))
    head = F.concat(F.lit('"""Module '), F.col("p").cast("string"), F.lit('."""\n'))
    return part.select(file_of(F.col("p")).alias("rel"), F.concat(head, F.when(roots, "").otherwise(imports), body).alias("text"), F.lit("python").alias("lang"))


def _filled(text, values):
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def file_of(key):
    return F.concat(F.lit("pkg"), _dir(key), F.lit("/mod"), key.cast("string"), F.lit(".py"))


def key_of(file):
    return F.regexp_extract(file, r"(\d+)\.py$", 1).cast("long")


def facts_of(spark: SparkSession, sf_dir: str, *only: str, more: tuple[str, ...] = (), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Facts of the tree as a written table, each kind in its own files; ``only`` these kinds, with ``columns`` and ``more``."""
    return written(python_facts(tree(spark, sf_dir, spread=True), only or RESOLVED, columns + more), "facts", by="fact")


def known_of(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> tuple[DataFrame, Resolved]:
    """Facts and what their names lead to; each query reads the references once."""
    facts = facts_of(spark, sf_dir, more=more)
    return facts, resolved(facts, keep=False)


def linked_of(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, Resolved]:
    """``known_of`` for those who ask which files lead to which: only of names that reach beyond their files."""
    facts = written(python_facts(tree(spark, sf_dir, spread=True), RESOLVED, OF_LINKS + more, across=True), "facts", by="fact")
    return facts, resolved(facts, keep=False, across=True)


def edges_of(known: Resolved) -> DataFrame:
    return written(codemap.file_edges(known.imports, known.references), "edges")


def graph_of(spark: SparkSession, sf_dir: str, *more: str) -> tuple[DataFrame, DataFrame]:
    facts, known = linked_of(spark, sf_dir, *more)
    return facts, edges_of(known)


_EDGES = """e AS (SELECT src, dst, CAST(sum(i) AS BIGINT) AS imports, CAST(sum(r) AS BIGINT) AS refs FROM (
SELECT p_partkey AS src, p_partkey // 2 AS dst, 2 AS i, 2 AS r FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3, 1, 1 FROM part WHERE p_partkey > 0) GROUP BY src, dst)"""
_DEGREE = f"""{_EDGES}, d AS (SELECT p_partkey AS p, CAST((SELECT count(*) FROM e WHERE dst = p_partkey) AS BIGINT) AS in_degree, CAST((SELECT count(*) FROM e WHERE src = p_partkey) AS BIGINT) AS out_degree,
CAST(coalesce((SELECT sum(imports + refs) FROM e WHERE dst = p_partkey), 0) AS BIGINT) AS inbound, CAST(coalesce((SELECT sum(imports + refs) FROM e WHERE src = p_partkey), 0) AS BIGINT) AS outbound FROM part)"""


@R.add("""SELECT p_partkey AS p, CAST(k.name AS VARCHAR) AS name, k.outcome AS outcome, k.target AS target FROM part, LATERAL (VALUES ('Other', 'def', p_partkey // 2), ('helper' || (p_partkey // 2), 'def', p_partkey // 2), ('far', 'module', p_partkey // 3), ('os', 'external', NULL)) AS k(name, outcome, target) WHERE p_partkey > 0""")
def q52_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_imports(facts_of(spark, sf_dir, "scope", "def", "import", columns=OF_IMPORTS))
    return found.select(key_of(F.col("file")).alias("p"), "name", "outcome", key_of(F.col("target_file")).alias("target"))


@R.add(f"WITH {_EDGES} SELECT * FROM e")
def q53_file_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, known = linked_of(spark, sf_dir)
    edges = codemap.file_edges(known.imports, known.references)
    return edges.select(key_of(F.col("src")).alias("src"), key_of(F.col("dst")).alias("dst"), "imports", "refs")


@R.add("""WITH u AS (SELECT p_partkey // 2 AS k, count(*) AS n FROM part WHERE p_partkey > 0 GROUP BY 1), v AS (SELECT p_partkey // 3 AS k, count(*) AS n FROM part WHERE p_partkey > 0 GROUP BY 1),
o AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT p_partkey // 2 AS k, p_partkey AS p FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 0) GROUP BY k)
SELECT p_partkey AS p, 'Thing' AS what, CAST(coalesce(u.n, 0) + 2 AS BIGINT) AS uses, CAST(coalesce(u.n, 0) AS BIGINT) AS files FROM part LEFT JOIN u ON u.k = p_partkey
UNION ALL SELECT p_partkey, 'helper', CAST(coalesce(u.n, 0) + coalesce(v.n, 0) + 1 AS BIGINT), CAST(coalesce(o.n, 0) AS BIGINT) FROM part LEFT JOIN u ON u.k = p_partkey LEFT JOIN v ON v.k = p_partkey LEFT JOIN o ON o.k = p_partkey
UNION ALL SELECT p_partkey, 'run', CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM part""")
def q54_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, known = known_of(spark, sf_dir)
    counted = codemap.reference_counts(facts, known.references).withColumn("what", F.regexp_extract("name", r"^([A-Za-z]+)", 1)).where("what in ('Thing', 'helper', 'run')")
    return counted.select(key_of(F.col("file")).alias("p"), "what", "uses", "files")


@R.add("""SELECT p_partkey AS p, CAST(k.line AS INTEGER) AS line, k.name AS name, k.target AS target, CAST(k.def_line - CASE WHEN k.target = 0 THEN 3 ELSE 0 END AS INTEGER) AS target_line FROM part, LATERAL (VALUES (9, 'Other', p_partkey // 2, 9), (16, 'helper' || (p_partkey // 2), p_partkey // 2, 19), (16, 'helper' || (p_partkey // 3), p_partkey // 3, 19)) AS k(line, name, target, def_line) WHERE p_partkey > 0""")
def q55_definitions_across_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the definition is of everything that a file uses of another."""
    facts, known = known_of(spark, sf_dir)
    defs = facts.where("fact = 'def'").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), F.col("line").alias("target_line"))
    met = known.references.where("outcome = 'def' and file <> target_file").join(defs, ["target_file", "target_ord"])
    return met.select(key_of(F.col("file")).alias("p"), "line", "name", key_of(F.col("target_file")).alias("target"), "target_line")


@R.add("""SELECT p_partkey AS p, CAST(8 AS BIGINT) AS defs, CAST(4 AS BIGINT) AS exports, CAST(CASE WHEN p_partkey > 0 THEN 22 ELSE 17 END AS BIGINT) AS refs, CAST(4 AS BIGINT) AS functions, CAST(4 AS BIGINT) AS longest, 2.8 AS mean_length, CAST(1 AS BIGINT) AS depth, CAST(1 AS BIGINT) AS branches FROM part""".replace("2.8", "CAST(2.8 AS DOUBLE)"))
def q56_file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("file", "fact", "scope", "kind", "name", "line", "end_line", "depth", "branches")
    found = codemap.file_facts(python_facts(tree(spark, sf_dir, spread=True), ("scope", "def", "ref"), columns))
    return found.select(key_of(F.col("file")).alias("p"), *[c for c in found.columns if c != "file"])


@R.add(f"WITH {_DEGREE} SELECT * FROM d")
def q57_file_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, edges = graph_of(spark, sf_dir)
    found = codemap.degrees(edges, facts.where("fact = 'scope' and parent is null").select("file"))
    return found.select(key_of(F.col("file")).alias("p"), "in_degree", "out_degree", "inbound", "outbound")


@R.add(f"WITH {_DEGREE} SELECT p, CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'isolated' WHEN out_degree = 0 THEN 'infra' WHEN in_degree = 0 THEN 'entry' ELSE 'domain' END AS layer FROM d")
def q58_file_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, edges = graph_of(spark, sf_dir)
    found = codemap.layers(codemap.degrees(edges, facts.where("fact = 'scope' and parent is null").select("file")))
    return found.select(key_of(F.col("file")).alias("p"), "layer")


@R.add(f"WITH {_DEGREE} SELECT p, 'hot' AS kind, in_degree AS score, in_degree AS inbound FROM d ORDER BY in_degree DESC, 'pkg' || (p % 7) || '/mod' || p || '.py' LIMIT 12")
def q59_start_here(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, edges = graph_of(spark, sf_dir, "text")
    found = codemap.start_here(codemap.degrees(edges, facts.where("fact = 'scope' and parent is null").select("file")), facts)
    return found.select(key_of(F.col("file")).alias("p"), "kind", "score", "inbound")


@R.add("""SELECT p_partkey AS p, k.caller AS caller, k.target AS target, k.callee AS callee, CAST(count(*) AS BIGINT) AS calls FROM part, LATERAL (VALUES ('run', p_partkey // 2, 'helper' || (p_partkey // 2), 1), ('run', p_partkey // 3, 'helper' || (p_partkey // 3), 1), ('helper' || p_partkey, p_partkey, 'Thing' || p_partkey, 0), ('twice' || p_partkey, p_partkey, 'Thing' || p_partkey, 0), ('twice' || p_partkey, p_partkey, 'run', 0), ('twice' || p_partkey, p_partkey, 'helper' || p_partkey, 0)) AS k(caller, target, callee, far)
WHERE p_partkey > 0 OR k.far = 0 GROUP BY ALL""")
def q60_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, known = known_of(spark, sf_dir)
    found = codemap.call_edges(facts, known.references)
    return found.select(key_of(F.col("caller_file")).alias("p"), "caller", key_of(F.col("callee_file")).alias("target"), "callee", "calls")


@R.add("""WITH RECURSIVE t AS (SELECT p_partkey AS p, p_partkey // 2 AS base, 1 AS dist FROM part WHERE p_partkey > 0 UNION ALL SELECT p, base // 2, dist + 1 FROM t WHERE base > 0) SELECT p, base, CAST(dist AS INTEGER) AS dist FROM t""")
def q61_type_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_of(spark, sf_dir, "scope", "def", "import", "base", more=("path",))
    found = codemap.ancestors_of_types(facts, resolve_imports(facts))
    number = lambda c: F.regexp_extract(c, r"Thing(\d+)$", 1).cast("long")
    return found.select(number("derived").alias("p"), number("base").alias("base"), "dist")


@R.add("""WITH RECURSIVE t AS (SELECT p_partkey AS p, p_partkey // 2 AS base FROM part WHERE p_partkey > 0 UNION ALL SELECT p, base // 2 FROM t WHERE base > 0) SELECT base, 'run' AS method, CAST(count(*) AS BIGINT) AS below FROM t GROUP BY base""")
def q62_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_of(spark, sf_dir, "scope", "def", "import", "base", more=("path",))
    found = codemap.implementations(facts, resolve_imports(facts))
    return found.groupBy(F.regexp_extract("base", r"Thing(\d+)$", 1).cast("long").alias("base"), "method").agg(F.count("*").alias("below"))


@R.add("""SELECT p_partkey AS p, k.path AS path, k.kind AS kind, CAST(k.depth AS INTEGER) AS depth FROM part, LATERAL (VALUES ('LIMIT', 'constant', 0), ('Thing' || p_partkey, 'class', 0), ('Thing' || p_partkey || '.__init__', 'constructor', 1), ('Thing' || p_partkey || '.run', 'method', 1), ('helper' || p_partkey, 'function', 0), ('twice' || p_partkey, 'function', 0)) AS k(path, kind, depth)""")
def q63_symbol_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codemap.definition_paths(python_facts(tree(spark, sf_dir, spread=True), ("def",))).select(key_of(F.col("file")).alias("p"), "path", "kind", "depth")


@R.add("""SELECT p_partkey AS p, CAST(CASE WHEN p_partkey = 0 THEN 0 ELSE floor(log2(p_partkey)) + 1 END AS INTEGER) AS level FROM part""")
def q64_file_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, edges = graph_of(spark, sf_dir)
    found = longest_levels(edges.select("src", "dst"), facts.where("fact = 'scope' and parent is null").select(F.col("file").alias("node")))
    return found.select(key_of(F.col("node")).alias("p"), "level")


@R.add("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0), d AS (SELECT src AS p, 1 AS depth FROM e WHERE dst = 1 UNION SELECT e.src, d.depth + 1 FROM d JOIN e ON e.dst = d.p WHERE d.depth < 5) SELECT p, CAST(min(depth) AS INTEGER) AS depth FROM d WHERE p <> 1 GROUP BY p""")
def q65_file_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = graph_of(spark, sf_dir)
    start = edges.sparkSession.createDataFrame([("pkg1/mod1.py",)], "node string")
    found = reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth=5)
    return found.select(key_of(F.col("node")).alias("p"), "depth")


@R.add("""SELECT CAST(count(*) AS BIGINT) AS files, CAST(0 AS BIGINT) AS on_cycles, CAST(count(*) - 1 AS BIGINT) AS os_imports, CAST(count(*) - 1 AS BIGINT) AS os_files FROM part""")
def q66_cycles_and_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, known = linked_of(spark, sf_dir)
    on_cycles = strongly_connected(edges_of(known).select("src", "dst")).agg(F.count("*").alias("on_cycles"))
    outside = codemap.external_packages(known.imports).where("package = 'os'").select(F.col("imports").alias("os_imports"), F.col("files").alias("os_files"))
    return facts.where("fact = 'scope' and parent is null").agg(F.count("*").alias("files")).crossJoin(F.broadcast(on_cycles)).crossJoin(F.broadcast(outside))


@R.add(f"""WITH {_EDGES} SELECT 'pkg' || (src % 7) AS src, 'pkg' || (dst % 7) AS dst, CAST(sum(imports) AS BIGINT) AS imports, CAST(sum(refs) AS BIGINT) AS refs, CAST(count(*) AS BIGINT) AS files FROM e WHERE src % 7 <> dst % 7 GROUP BY 1, 2""")
def q67_folder_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, known = linked_of(spark, sf_dir)
    return codemap.dir_edges(codemap.file_edges(known.imports, known.references))


@R.add("""SELECT 'pkg' || (p_partkey % 7) AS dir, CAST(count(*) AS BIGINT) AS files FROM part GROUP BY 1 UNION ALL SELECT '', CAST(count(*) AS BIGINT) FROM part""")
def q68_subtree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codemap.subtree_counts(tree(spark, sf_dir).select(F.col("rel").alias("file")))


@R.add("""SELECT p, target, callee, name, CAST(count(*) AS BIGINT) AS calls FROM (SELECT p_partkey AS p, p_partkey // 2 AS target, 'helper' || (p_partkey // 2) AS callee, 'x' AS name FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey, 'run', 'x' FROM part UNION ALL SELECT p_partkey, p_partkey, 'helper' || p_partkey, 'x' FROM part) GROUP BY ALL""")
def q69_argument_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, known = known_of(spark, sf_dir)
    found = codemap.argument_flow(facts, known.references)
    return found.select(key_of(F.col("caller_file")).alias("p"), key_of(F.col("callee_file")).alias("target"), "callee", "name", "calls")
