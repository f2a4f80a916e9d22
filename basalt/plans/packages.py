"""Code questions over packages with what the modules of ``code`` don't hold: re-exports, stars, nested and same-named
classes, comprehensions, keywords, types that only constructors' calls tell, and import cycles.

Each supplier is written out as a package of four files; the SQL says what is true of every one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codemap, positions
from ..operators.graph import strongly_connected
from ..operators.resolve import resolved
from ..sources.python_facts import python_facts
from ..sources.shared import written
from .base import Registry, table

R = Registry()

_FILES = {
    "__init__.py": "from .base import Core{s} as Kernel\nfrom .util import *\n",
    "base.py": """from sup{s} import util


class Core{s}:
    class Meta:
        label = {s}

    def boot(self, level):
        return util.shine(level, self)

    @staticmethod
    def fixed(level):
        return level


class Shell{s}:
    class Meta:
        label = -{s}
""",
    "util.py": """from sup{s} import base


def shine(level, who):
    return [base.Core{s}.fixed(w) for w in range(level)]


def late():
    return base.Shell{s}.Meta.label
""",
    "use.py": """from typing import Any

from sup{s} import Kernel, shine
from sup{s}.base import Shell{s}


class Holder{s}:
    def __init__(self, part: Any, level=1):
        self.part = part

    def run(self, level):
        return self.part.boot(level=level)


def labels(who):
    pick = lambda k: shine(level=k, who=who)
    return pick, [shine(k, who) for k in (Kernel.Meta.label, Shell{s}.Meta.label)]


def start():
    try:
        held = Holder{s}(Kernel())
    except ValueError as error:
        return error
    same = held
    return same.run(2)
""",
}


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, text, lang): four files a supplier."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s"))
    files = F.array(*[F.struct(F.concat(F.lit("sup"), F.col("s"), F.lit(f"/{name}")).alias("rel"), F.replace(F.lit(text), F.lit("{s}"), F.col("s")).alias("text")) for name, text in _FILES.items()])
    return supplier.select(F.explode(files).alias("f")).select("f.rel", "f.text", F.lit("python").alias("lang"))


def facts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = packages(spark, sf_dir)
    return written(python_facts(files.repartition(max(1, min(64, spark.sparkContext.defaultParallelism)))), "facts", by="fact")


def supplier_of(file):
    return F.regexp_extract(file, r"^sup(\d+)/", 1).cast("long")


def name_of(file):
    return F.regexp_extract(file, r"/(\w+)\.py$", 1)


@R.add("""SELECT s_suppkey AS s, k.file, CAST(k.line AS INTEGER) AS line, k.name, k.target, CAST(k.target_line AS INTEGER) AS target_line FROM supplier, LATERAL (VALUES ('base', 9, 'shine', 'util', 4), ('util', 5, 'fixed', 'base', 12), ('util', 9, 'label', 'base', 18), ('use', 12, 'boot', 'base', 8),
('use', 16, 'shine', 'util', 4), ('use', 17, 'shine', 'util', 4), ('use', 17, 'label', 'base', 6), ('use', 17, 'label', 'base', 18), ('use', 26, 'run', 'use', 11)) AS k(file, line, name, target, target_line)""")
def q85_members_across_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains, re-exports, stars and types lead: the same-named inner classes apart, and the type that only calls tell."""
    facts = facts_of(spark, sf_dir)
    found = resolved(facts).references.where("outcome = 'def' and name in ('shine', 'fixed', 'label', 'boot', 'run')")
    lines = facts.where("fact = 'def'").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), F.col("line").alias("target_line"))
    return found.join(lines, ["target_file", "target_ord"]).select(supplier_of(F.col("file")).alias("s"), name_of(F.col("file")).alias("file"), "line", "name", name_of(F.col("target_file")).alias("target"), "target_line")


@R.add("""SELECT s_suppkey AS s, replace(k.caller, '#', CAST(s_suppkey AS VARCHAR)) AS caller, replace(k.callee, '#', CAST(s_suppkey AS VARCHAR)) AS callee, CAST(k.calls AS BIGINT) AS calls FROM supplier, LATERAL (VALUES ('boot', 'shine', 1), ('shine', 'fixed', 1), ('run', 'boot', 1), ('labels', 'shine', 2), ('start', 'Holder#', 1), ('start', 'Core#', 1), ('start', 'run', 1)) AS k(caller, callee, calls)""")
def q86_callers_through_comprehensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_of(spark, sf_dir)
    found = codemap.call_edges(facts, resolved(facts).references)
    return found.select(supplier_of(F.col("caller_file")).alias("s"), "caller", "callee", "calls")


@R.add("""SELECT s_suppkey AS s, k.callee, k.name, CAST(k.calls AS BIGINT) AS calls FROM supplier, LATERAL (VALUES ('shine', 'level', 1), ('shine', 'who', 2), ('boot', 'level', 1)) AS k(callee, name, calls)""")
def q87_arguments_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_of(spark, sf_dir)
    found = codemap.argument_flow(facts, resolved(facts).references)
    return found.select(supplier_of(F.col("caller_file")).alias("s"), "callee", "name", "calls").groupBy("s", "callee", "name").agg(F.sum("calls").alias("calls"))


@R.add("""SELECT s_suppkey AS s, replace(k.name, '#', CAST(s_suppkey AS VARCHAR)) AS name, replace(k.type, '#', CAST(s_suppkey AS VARCHAR)) AS type FROM supplier, LATERAL (VALUES ('Holder#.__init__.self', 'Holder#'), ('Holder#.run.self', 'Holder#'), ('Holder#.__init__.part', 'Core#'), ('Holder#.part', 'Core#'), ('start.held', 'Holder#'), ('start.same', 'Holder#')) AS k(name, type)""")
def q88_types_by_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of values in the files that use others: declared, made, taken over, and agreed on by a constructor's calls."""
    facts = facts_of(spark, sf_dir)
    known = resolved(facts)
    classes = facts.where("fact = 'def' and kind = 'class'").select(F.col("body").alias("owner"), F.col("name").alias("type"))
    names = facts.where("fact = 'def' and kind <> 'class' and file like '%/use.py'").select("file", "ord", "path")
    return names.join(known.types, ["file", "ord"]).join(classes, "owner").select(supplier_of(F.col("file")).alias("s"), F.col("path").alias("name"), "type").distinct()


@R.add("""SELECT s_suppkey AS s, k.node, 'base' AS component FROM supplier, LATERAL (VALUES ('base'), ('util')) AS k(node)""")
def q89_import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a package that need each other."""
    facts = facts_of(spark, sf_dir)
    known = resolved(facts)
    found = strongly_connected(codemap.file_edges(known.imports, known.references).select("src", "dst"))
    return found.select(supplier_of(F.col("node")).alias("s"), name_of(F.col("node")).alias("node"), name_of(F.col("component")).alias("component"))


@R.add("""SELECT s_suppkey AS s, k.* FROM supplier, LATERAL (VALUES ('__init__', 'Kernel', 'def', 'base'), ('__init__', '*', 'module', 'util'), ('base', 'util', 'module', 'util'), ('util', 'base', 'module', 'base'), ('use', 'Any', 'external', NULL), ('use', 'Kernel', 'def', 'base')) AS k(file, name, outcome, target)
UNION ALL SELECT s_suppkey, 'use', 'Shell' || s_suppkey, 'def', 'base' FROM supplier UNION ALL SELECT s_suppkey, 'use', 'shine', 'def', 'util' FROM supplier""")
def q90_imports_of_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolved(facts_of(spark, sf_dir)).imports
    return found.select(supplier_of(F.col("file")).alias("s"), name_of(F.col("file")).alias("file"), "name", "outcome", name_of(F.col("target_file")).alias("target"))


@R.add("""SELECT s_suppkey AS s, k.file, CAST(k.line AS INTEGER) AS line, k.kind FROM supplier, LATERAL (VALUES ('__init__', 1, 'import'), ('use', 3, 'import'), ('util', 5, 'ref'), ('use', 17, 'ref'), ('use', 22, 'ref')) AS k(file, line, kind)""")
def q45_references_with_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place that means a package's core class, under its own name, through a module, or under the name that it is handed on by."""
    facts = facts_of(spark, sf_dir)
    known = resolved(facts)
    core = facts.where("fact = 'def' and kind = 'class' and name like 'Core%'").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"))
    found = positions.references_to(facts, known.references, known.imports).join(core, ["target_file", "target_ord"])
    return found.select(supplier_of(F.col("target_file")).alias("s"), name_of(F.col("file")).alias("file"), "line", "kind")


@R.add("""SELECT s_suppkey AS s, replace(k.chain, '#', CAST(s_suppkey AS VARCHAR)) AS chain, k.target, CAST(k.line AS INTEGER) AS line FROM supplier, LATERAL (VALUES ('base.Core#.fixed', 'base', 12), ('base.Shell#.Meta', 'base', 17), ('base.Shell#.Meta.label', 'base', 18), ('self.part.boot', 'base', 8), ('Kernel.Meta.label', 'base', 6), ('Shell#.Meta.label', 'base', 18)) AS k(chain, target, line)""")
def q46_member_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chains of three segments and more lead."""
    facts = facts_of(spark, sf_dir)
    chains = facts.where("fact = 'ref' and size(parts) > 2").select("file", "ord", F.array_join("parts", ".").alias("chain"))
    lines = facts.where("fact = 'def'").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), "line")
    found = chains.join(resolved(facts).references.drop("line"), ["file", "ord"]).where("outcome = 'def'").join(lines, ["target_file", "target_ord"])
    return found.select(supplier_of(F.col("file")).alias("s"), "chain", name_of(F.col("target_file")).alias("target"), "line")
