"""Names, classes and types across files: cases that small modules of one shape don't hold."""

from __future__ import annotations

import pytest

from basalt.operators import codemap
from basalt.operators.calltree import call_tree
from basalt.operators.levels import shown_as
from basalt.operators.positions import around, definitions_at, literals_at, stabbed, widths
from basalt.operators import resolve
from basalt.operators.resolve import inherited, members, resolved
from basalt.plans import code
from basalt.operators.summaries import unresolved_reasons
from basalt.sources.python_facts import python_facts
from basalt.sources.shared import written

TREE = {
    "pkg/__init__.py": "from .deep.core import Core as Kernel\nfrom .stars import *\n",
    "pkg/deep/__init__.py": "from .core import Core\n",
    "pkg/deep/core.py": "class Core:\n    def boot(self):\n        return 1\n\n    @staticmethod\n    def st(q):\n        return q\n",
    "pkg/stars.py": "def shine(w, q):\n    return w\n",
    "pkg/more.py": "def glow(w):\n    return w\n",
    "meta.py": "class A:\n    class Meta:\n        one = 1\n\n\nclass B:\n    class Meta:\n        one = 3\n\n    class Inner(Meta):\n        pass\n\n\nuse = (A.Meta.one, B.Meta.one, B.Inner.one)\n",
    "pool.py": "from typing import Any\nfrom pkg.deep.core import Core\n\n\nclass Pool:\n    def __init__(self, core: Any, size=1):\n        self.core = core\n\n    def run(self):\n        self.core.boot()\n\n\nclass Split:\n    def __init__(self, thing):\n        self.thing = thing\n\n    def run(self):\n        self.thing.boot()\n\n\nclass Main(Core):\n    def start(self):\n        pool = Pool(core=self)\n        again = pool\n        again.run()\n        Split(self)\n        Split(Pool(self))\n        self.boot()\n\n\ndef make() -> Pool:\n    return Pool(Main())\n\n\ndef other():\n    p = make()\n    p.run()\n",
    "calls.py": "from pkg import Kernel, shine\nfrom pkg.stars import *\nfrom pkg.more import *\nimport pkg.deep.core\n\n\ndef g(x):\n    return x\n\n\ndef f(xs):\n    h = lambda y: g(y)\n    return [g(x) for x in xs], glow(xs)\n\n\nclass K:\n    def __init__(self, w):\n        self.w = w\n\n\ndef u(w, q):\n    shine(w=q, q=q)\n    K(w)\n    Kernel.st(q)\n    Kernel().boot()\n    pkg.deep.core.Core()\n    print(w)\n",
    "binds.py": "def f(v):\n    try:\n        pass\n    except (ValueError, KeyError) as err:\n        print(err)\n    match v:\n        case [first, *rest]:\n            return first, rest\n        case {'k': 1, **others}:\n            return others\n        case str() as text:\n            return text\n    if any((last := x) for x in v):\n        return last\n    n = 0\n    n += 1\n    return n\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    return python_facts(spark.createDataFrame([(f, t, "python") for f, t in TREE.items()], "rel string, text string, lang string")).persist()


@pytest.fixture(scope="module")
def known(facts):
    return resolved(facts)


@pytest.fixture(scope="module")
def ends(facts, known):
    """(file, line, name) of a reference: its outcome, and file and line of its definition."""
    at = {(r["file"], r["ord"]): r["line"] for r in facts.where("fact = 'def'").collect()}
    return {(r["file"], r["line"], r["name"], r["col"]): (r["outcome"], r["target_file"], at.get((r["target_file"], r["target_ord"]))) for r in known.references.collect()}


def of(ends, file, line, name):
    return [v for k, v in sorted(ends.items()) if k[:3] == (file, line, name)]


def test_classes_of_one_name_are_told_apart(ends, facts, known):
    assert of(ends, "meta.py", 14, "one") == [("def", "meta.py", 3), ("def", "meta.py", 8), ("def", "meta.py", 8)]
    assert {tuple(r) for r in codemap.ancestors_of_types(facts, known.imports).collect()} == {("meta.py:B.Inner", "meta.py:B.Meta", 1), ("pool.py:Main", "pkg/deep/core.py:Core", 1)}
    assert codemap.ancestors_of_types(facts, known.imports, depth=0).count() == 0


def test_reexports_stars_and_packages(ends, known):
    got = {(r["file"], r["name"]): (r["outcome"], r["target_file"]) for r in known.imports.collect()}
    assert got["calls.py", "Kernel"] == ("def", "pkg/deep/core.py") and got["calls.py", "pkg"] == ("module", "pkg/__init__.py")
    assert of(ends, "calls.py", 13, "glow") == [("def", "pkg/more.py", 1)]  # the second of two stars
    assert of(ends, "calls.py", 24, "Kernel") == [("def", "pkg/deep/core.py", 1)] and of(ends, "calls.py", 24, "st") == [("def", "pkg/deep/core.py", 6)]
    assert of(ends, "calls.py", 26, "Core") == [("def", "pkg/deep/core.py", 1)] and of(ends, "calls.py", 27, "print")[0][0] == "external"


def test_types_spread_through_assignments_and_constructors(ends, known):
    assert of(ends, "pool.py", 10, "boot") == [("def", "pkg/deep/core.py", 2)]  # Any, but every call gives a Main
    assert of(ends, "pool.py", 18, "boot")[0][0] == "unresolved"  # two calls that don't agree
    assert of(ends, "pool.py", 25, "run") == [("def", "pool.py", 9)] and of(ends, "pool.py", 37, "run") == [("def", "pool.py", 9)]
    assert of(ends, "pool.py", 28, "boot") == [("def", "pkg/deep/core.py", 2)]


def test_callers_and_arguments(facts, known):
    calls = {(r["caller_file"], r["caller"], r["callee"]): r["calls"] for r in codemap.call_edges(facts, known.references).collect()}
    assert calls["calls.py", "f", "g"] == 2 and calls["calls.py", "f", "glow"] == 1 and ("calls.py", "<module>", "g") not in calls
    assert calls["calls.py", "u", "shine"] == 1 and calls["calls.py", "u", "K"] == 1 and calls["pool.py", "start", "Split"] == 2
    flow = {(r["callee"], r["name"]): r["calls"] for r in codemap.argument_flow(facts, known.references).where("caller_file = 'calls.py'").collect()}
    assert flow == {("shine", "q"): 1, ("K", "w"): 1, ("st", "q"): 1, ("g", "x"): 1}


def test_names_bound_without_a_node(facts):
    defs = {r["name"]: (r["name_line"], r["name_col"], r["scope"]) for r in facts.where("file = 'binds.py' and fact = 'def' and name <> 'f'").collect()}
    assert (defs["err"][:2], defs["first"][:2], defs["rest"][:2], defs["others"][:2], defs["text"][:2]) == ((4, 38), (7, 15), (7, 23), (9, 25), (11, 23))
    assert defs["last"][2] == defs["n"][2] == defs["v"][2]
    found = {(r["name"], r["line"]): r["found"] for r in facts.where("file = 'binds.py' and fact = 'ref'").collect()}
    assert found["err", 5] == found["first", 8] == found["others", 10] == found["text", 12] == found["last", 14] == found["n", 16] == "def"
    assert [r["name"] for r in facts.where("file = 'binds.py' and fact = 'def' and name = 'n'").collect()] == ["n"]


def test_reasons_of_unresolved_names(spark):
    tree = {"p/__init__.py": "", "p/a.py": "from .gone import *\n\nx = lost\n", "b.py": "from outside import *\n\ny = lost\n", "c.py": "def f(v, w):\n    v.any()\n    w[0].no\n    return nobody, v.k[1]\n"}
    facts = python_facts(spark.createDataFrame([(f, t, "python") for f, t in tree.items()], "rel string, text string, lang string")).persist()
    known = resolved(facts)
    got = {(r["file"], r["line"], r["name"]): r["reason"] for r in unresolved_reasons(facts, known.references, known.imports).collect()}
    assert got == {("p/a.py", 3, "lost"): "module-not-found", ("b.py", 3, "lost"): "not-in-project", ("c.py", 2, "any"): "needs-type-info", ("c.py", 3, "no"): "dynamic-member", ("c.py", 4, "nobody"): "needs-type-info", ("c.py", 4, "k"): "dynamic-member"}


def test_call_trees_and_levels(facts, known):
    roots = facts.where("fact = 'def' and name = 'start' and file = 'pool.py'").select("file", "ord")
    nodes, summary = call_tree(facts, known.references, roots, "out", depth=2)
    got = [(r["level"], r["name"], r["calls"]) for r in nodes.orderBy("place").collect()]
    assert got[0] == (0, "start", 0) and {g[1:] for g in got[1:]} >= {("Pool", 2), ("Split", 2), ("run", 1), ("boot", 1)}
    row = summary.first()
    assert not row["truncated"] and row["nodes"] == len(got) - 1
    _, cut = call_tree(facts, known.references, roots, "out", depth=2, most=2)
    assert cut.first()["truncated"] and cut.first()["nodes"] == 2
    roots = facts.where("fact = 'def' and name = 'boot'").select("file", "ord")
    up, _ = call_tree(facts, known.references, roots, "in", depth=1)
    assert {r["name"] for r in up.where("level = 1").collect()} == {"run", "start"}
    files = facts.where("fact = 'scope' and parent is null").select("file")
    shown = {r["file"]: r["node"] for r in shown_as(files, facts.sparkSession.createDataFrame([("",), ("pkg",)], "dir string"), nested=True).collect()}
    assert shown["meta.py"] == "meta.py" and shown["pkg/stars.py"] == "pkg/stars.py" and shown["pkg/deep/core.py"] == "pkg/deep"
    plain = {r["file"]: r["node"] for r in shown_as(files, facts.sparkSession.createDataFrame([("pkg",)], "dir string")).collect()}
    assert plain["meta.py"] == "" and plain["pkg/more.py"] == "pkg/more.py" and plain["pkg/deep/core.py"] == "pkg/deep"


def test_positions(spark, facts, known):
    points = spark.createDataFrame([("pool.py", 10, 14), ("pool.py", 10, 20), ("pool.py", 23, 22), ("pool.py", 12, 1), ("calls.py", 1, 20), ("pool.py", 2, 30)], "file string, line int, col int")
    got = {(r["file"], r["at_line"], r["at_col"]): (r["symbol"], r["reason"], r["target_file"], r["target_line"], r["target_col"]) for r in definitions_at(points, facts, known.references, known.imports).collect()}
    assert got["pool.py", 10, 14] == ("core", "resolved", "pool.py", 7, 14) and got["pool.py", 10, 20] == ("boot", "resolved", "pkg/deep/core.py", 2, 9)
    assert got["pool.py", 12, 1] == (None, "no-symbol", None, None, None) and got["calls.py", 1, 20] == ("Kernel", "resolved", "pkg/deep/core.py", 1, 7)
    inner = {(r["at_line"], r["at_col"]): r["name"] for r in around(points.where("file = 'pool.py'"), facts).collect()}
    assert inner == {(10, 14): "run", (10, 20): "run", (23, 22): "start"}
    assert [r["text"] for r in literals_at(spark.createDataFrame([("meta.py", 3, 15)], "file string, line int, col int"), facts).collect()] == ["1"]
    ranges = spark.createDataFrame([(1, k, k + k * k) for k in range(1, 60)], "g int, a int, b int")
    asked = spark.createDataFrame([(1, t) for t in range(0, 4000, 7)], "g int, t int")
    assert {(r["t"], r["a"]) for r in stabbed(asked, ranges, ["g"], "t", "a", "b", narrowest=3).collect()} == {(t, k) for t in range(0, 4000, 7) for k in range(1, 60) if k <= t <= k + k * k}


def test_inheritance_by_doubling_ends_on_cycles(spark):
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x")], "derived string, base string")
    got = {(r["derived"], r["base"]): r["dist"] for r in inherited(edges).collect()}
    assert len(got) == 45 + 2 and got["c0", "c9"] == 9 and got["x", "y"] == 1


def test_members_come_from_the_nearest_class_above(spark):
    """A diamond, a cycle, and a chain whose lower classes hold nothing; each class's own comes first."""
    direct = spark.createDataFrame([("top", "m", "f", 1, 0), ("left", "m", "f", 2, 0), ("right", "m", "f", 3, 0), ("right", "n", "f", 4, 0), ("x", "c", "f", 5, 0)], "owner string, name string, file string, ord int, rank int")
    bases = spark.createDataFrame([("left", "top"), ("right", "top"), ("low", "left"), ("low", "right"), ("x", "y"), ("y", "x")] + [(f"k{i}", f"k{i + 1}") for i in range(9)] + [("k9", "top")], "derived string, base string")
    facts = python_facts(spark.createDataFrame([("a.py", "x = 1\n", "python")], "rel string, text string, lang string"))
    got = {(r["owner"], r["name"]): r["ord"] for r in members(facts, direct, bases).collect()}
    assert got["low", "m"] == 2 and got["low", "n"] == 4 and got["k0", "m"] == 1 and got["y", "c"] == 5 and got["left", "m"] == 2
    assert len(got) == 5 + 2 + 1 + 10


def test_inheritance_makes_each_pair_once(spark, monkeypatch):
    """Of a chain, rounds write each pair once; before, each wrote all pairs made so far anew."""
    made = []

    def counted(df, label="step"):
        out = written(df, label)
        made.append(out.count())
        return out

    monkeypatch.setattr(resolve, "written", counted)
    edges = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(20)], "derived string, base string")
    assert inherited(edges).count() == 210 == sum(made)


def test_only_wanted_facts_and_tasks_by_number_of_files(spark, sf):
    files = spark.createDataFrame([("a.py", "import b\nx = b.y\n", "python")], "rel string, text string, lang string")
    assert {r["fact"] for r in python_facts(files, ("def", "import")).collect()} == {"def", "import"}
    few, code.FILES_A_TASK = code.FILES_A_TASK, 20
    try:
        assert code.tree(spark, sf, spread=True).rdd.getNumPartitions() == 10
    finally:
        code.FILES_A_TASK = few


def test_places_are_not_broadcast_and_ask_only_at_widths_that_ranges_have(spark, facts, known):
    points = spark.createDataFrame([("pool.py", 10, 14)], "file string, line int, col int")
    plan = definitions_at(points, facts, known.references, known.imports)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    ranges = spark.createDataFrame([(1, 1, 3), (1, 5, 9), (1, 1, 1000)], "g int, a int, b int")
    assert widths(ranges, "a", "b") == [0, 2] and widths(ranges.limit(0), "a", "b") == []
    asked = spark.createDataFrame([(1, 2), (1, 999)], "g int, t int")
    assert {tuple(r) for r in stabbed(asked, ranges, ["g"], "t", "a", "b").select("t", "a").collect()} == {(2, 1), (999, 1)}
    assert stabbed(asked, ranges.limit(0), ["g"], "t", "a", "b").count() == 0
