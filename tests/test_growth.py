"""What keeps queries over large trees of files small: columns and kinds of facts, numbers for classes, no needless sort."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.operators import codemap, graph, levels, positions
from basalt.operators.resolve import resolve_imports, resolved
from basalt.plans.code import OF_LINKS, RESOLVED
from basalt.sources import python_facts as python_facts_module
from basalt.sources.python_facts import extract_python, python_facts
from basalt.sources.shared import written

FILES = [("a.py", "class A:\n    def run(self): pass\n", "python"), ("b.py", "from a import A\nclass B(A):\n    def run(self): pass\nB()\n", "python")]


def _facts(spark, *args):
    return python_facts(spark.createDataFrame(FILES, "rel string, text string, lang string"), *args)


def test_facts_by_kind_with_asked_columns(spark):
    found = _facts(spark, ("def", "import"), ("file", "fact", "name"))
    kept = written(found, "facts", by="fact")
    assert kept.columns == found.columns == ["file", "fact", "name"]
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, found.collect()))
    assert all("fact=import" in f for f in kept.where("fact = 'import'").select("_metadata.file_path").toPandas()["file_path"])


def test_calls_know_what_binds_them():
    calls = [r for r in extract_python(*FILES[1][:2]) if r["fact"] == "call"]
    assert [(c["name"], c["found"]) for c in calls] == [("B", "def")]


def test_parser_makes_only_the_rows_that_are_asked_for(monkeypatch):
    text = "import os\nfrom a import A as B\nclass C(B):\n    'Doc.'\n    def run(self, x: B = 1):\n        self.y = B(x, k=[z.n for z in x])\n        return lambda q: os.path.join(q[0], x.y.z) if (w := x) else w\n"
    whole = extract_python("c.py", text)
    for only in (("scope", "def", "import"), ("def",), ("ref",), ("argument",), ("call", "literal", "base")):
        assert extract_python("c.py", text, frozenset(only)) == [r for r in whole if r["fact"] in only]
    made, empty = [], python_facts_module._EMPTY

    class Counted(dict):
        def copy(self):
            made.append(1)
            return dict(self)

    monkeypatch.setattr(python_facts_module, "_EMPTY", Counted(empty))
    monkeypatch.setattr(python_facts_module, "complexity", None)
    rows = extract_python("c.py", text, frozenset(("scope", "def", "import")), frozenset(("file", "fact", "ord")))
    assert len(made) == len(rows) < len(whole)


def test_hierarchy_goes_by_numbers(spark):
    facts = written(_facts(spark), "facts", by="fact")
    above, _ = codemap._hierarchy(facts, resolve_imports(facts))
    assert dict(above.dtypes)["derived"] == dict(above.dtypes)["base"] == "bigint"
    assert [tuple(r) for r in codemap.ancestors_of_types(facts).collect()] == [("b.py:B", "a.py:A", 1)]


def test_level_graph_sorts_only_what_is_cut(spark):
    edges = spark.createDataFrame([("x/a.py", "y/b.py", 1, 1), ("x/c.py", "y/b.py", 1, 0)], "src string, dst string, imports long, refs long")
    files = spark.createDataFrame([("x/a.py",), ("y/b.py",), ("x/c.py",)], "file string")
    graph = lambda most: levels.level_graph(edges, files, files.select(F.lit("x").alias("dir")).limit(1), most_files=most)
    nodes, between = graph(10)
    assert "TakeOrdered" not in nodes._jdf.queryExecution().toString()
    assert {r["node"] for r in nodes.where("kind = 'file'").collect()} == {"x/a.py", "x/c.py"} and between.count() == 2
    cut, between = graph(1)
    assert [r["node"] for r in cut.where("kind = 'file'").collect()] == ["x/a.py"] and between.count() == 1


ODD = {
    "pkg/__init__.py": "from .core import Core as Kernel\nfrom .stars import *\nimport pkg.core\n",
    "pkg/core.py": "class Core:\n    def boot(self):\n        return self\n\nclass Low(Core):\n    def low(self):\n        self.boot()\n        self.low()\n",
    "pkg/stars.py": "def shine(w):\n    return w\n_hidden = 1\n",
    "two.py": "class A:\n    one = 1\n    class In:\n        x = 2\nclass A:\n    two = A.one\n    def __init__(self, k, t: 'A' = None):\n        self.k = k\n        self.t = t\n    def run(self):\n        return self.k.boot() + self.one + self.t.two + self.t.gone\nA.In.x\nA.two\n",
    "use.py": "import pkg\nimport pkg.core as core, os.path as p\nfrom pkg import Kernel, shine, nothing, core as again\nfrom two import A\nfrom . import two\ntry:\n    import gone as x\nexcept ImportError:\n    import two as x\n\ndef f(q):\n    a = A(Kernel())\n    b = a\n    b.run()\n    core.Low().boot()\n    l = core.Low(); l.boot(); l.low()\n    m = make(); m.low()\n    pkg.shine(q); pkg._hidden; pkg.core.Low; again.Core; x.A; two.A.In; p.join; nothing.k; shine(a.k.boot)\n    return A(k=l)\n\ndef make() -> core.Low:\n    return core.Low()\n",
}


def test_what_files_tell_leads_where_joins_lead(spark):
    """With what the parser settles within files, and without: the joins alone must come to the same."""
    facts = written(python_facts(spark.createDataFrame([(f, t, "python") for f, t in ODD.items()], "rel string, text string, lang string")), "facts", by="fact")
    told = ("settled", "settled_body", "alone", "inner")
    bare = written(facts.withColumns({c: F.lit(None).cast(dict(facts.dtypes)[c]) for c in told} | {"body": F.when(F.col("fact").isin("base") | (F.col("kind") == "parameter"), None).otherwise(F.col("body")), "binds": F.when(F.col("fact") != "argument", F.col("binds"))}), "facts", by="fact")
    near, far = resolved(facts), resolved(bare)
    for what in ("imports", "bases", "references"):
        a, b = getattr(near, what).drop("alone"), getattr(far, what).drop("alone")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), what
    assert {r["name"] for r in near.references.where("outcome = 'def'").collect()} >= {"boot", "low", "two", "one", "In", "x"}


def test_names_told_within_a_file_carry_where_they_lead():
    rows = {(r["fact"], r["name"], r["ord"]): r for r in extract_python("a.py", "class A:\n    def __init__(self, s):\n        self.s = s\n    def run(self):\n        return self.s\ndef f(x):\n    a = A(x)\n    a.run()\n    f(x)\n")}
    by = lambda fact, name: [r for k, r in sorted(rows.items(), key=lambda i: i[0][2]) if k[:2] == (fact, name)]
    assert [r["settled"] for r in by("ref", "run")] == [r["ord"] for r in by("def", "run")] and by("ref", "s")[-1]["settled"] == by("def", "s")[-1]["ord"]
    assert by("def", "a")[0]["settled_body"] is not None and by("def", "a")[0]["inner"] and not by("def", "run")[0]["inner"] and by("def", "run")[0]["alone"]
    assert [(r["settled"], r["binds"]) for k, r in sorted(rows.items(), key=lambda i: i[0][2]) if k[0] == "argument"] == [(-1, True), (-1, False)]


def test_what_reaches_beyond_a_file_gives_the_same_graph(spark):
    """Edges and levels from only the rows that other files are needed for."""
    typed = {"box.py": "class Box:\n    def __init__(self, k):\n        self.k = k\n    def go(self):\n        return self.k.boot()\n", "call.py": "from box import Box\nfrom pkg.core import Low\nBox(Low()).go()\n"}
    files = spark.createDataFrame([(f, t, "python") for f, t in (ODD | typed).items()], "rel string, text string, lang string")
    whole = written(python_facts(files), "facts", by="fact")
    few = written(python_facts(files, RESOLVED, OF_LINKS, across=True), "facts", by="fact")
    assert few.count() < whole.where(F.col("fact").isin(*RESOLVED)).count() * 0.8
    edges = [sorted(map(tuple, codemap.file_edges(k.imports, k.references).collect())) for k in (resolved(whole), resolved(few, across=True))]
    assert edges[0] == edges[1] and any(e[:2] == ("box.py", "pkg/core.py") for e in edges[0])


def test_types_are_worked_out_only_where_chains_ask(spark, monkeypatch):
    from basalt.operators import resolve

    asked = []
    monkeypatch.setattr(resolve, "value_types", lambda *a, types=resolve.value_types: asked.append(1) or types(*a))
    made = lambda text: written(python_facts(spark.createDataFrame([FILES[0], ("c.py", text, "python")], "rel string, text string, lang string")), "facts", by="fact")
    assert "def" in [r["outcome"] for r in resolved(made("import a\na.A\n")).references.collect()] and not asked
    assert [r["target_ord"] is not None for r in resolved(made("from a import A\nx = A()\nx.run\n")).references.where("name = 'run'").collect()] == [True] and asked


def test_levels_use_each_edge_once(spark, monkeypatch):
    """Of a graph whose layers double, peeled edges are few times the edges; before, every round went over all of them."""
    made = []

    def counted(df, label="step", by=None):
        out = written(df, label, by)
        if label in ("peeled", "levels", "step"):
            made.append((label, out.count()))
        return out

    monkeypatch.setattr(graph, "written", counted)
    n = 400
    edges = spark.createDataFrame([(k, d) for k in range(1, n) for d in {k // 2, k // 3}], "src int, dst int")
    nodes = spark.createDataFrame([(k,) for k in range(n)], "node int")
    assert {r["node"]: r["level"] for r in graph.longest_levels(edges, nodes).collect()} == {k: k.bit_length() for k in range(n)}
    peeled = [m for label, m in made if label == "peeled"]
    assert peeled[0] < 2 * n and sum(peeled) < 2.5 * peeled[0] and sum(m for label, m in made if label == "levels") < 4 * n


def test_levels_of_a_thin_graph_below_a_wide_one(spark):
    """A ladder is climbed, what fans out above it is peeled."""
    ladder = [(k, d) for k in range(2, 30) for d in (k - 1, k - 2)]
    fan = [(1000 + k, d) for k in range(300) for d in (29, 28 - k % 3)]
    edges = spark.createDataFrame(ladder + fan, "src int, dst int")
    nodes = spark.createDataFrame([(n,) for n in {x for e in ladder + fan for x in e}], "node int")
    levels_of = {r["node"]: r["level"] for r in graph.longest_levels(edges, nodes).collect()}
    assert all(levels_of[k] == k - 1 for k in range(1, 30)) and levels_of[0] == 0 and all(levels_of[1000 + k] == 29 for k in range(300))


def test_places_of_a_line_meet_its_names_together(spark):
    """An import over two lines, places asked twice, and plans in which no place is shuffled by its column."""
    text = "from a import (A as\n  B, C)\nB(C); A\n"
    facts = written(python_facts(spark.createDataFrame([FILES[0], ("c.py", text, "python")], "rel string, text string, lang string")), "facts", by="fact")
    known = resolved(facts)
    points = spark.createDataFrame([("c.py", line, col) for line, col in ((1, 16), (1, 16), (2, 3), (2, 4), (2, 6), (3, 1), (3, 3), (3, 7), (4, 1))], "file string, line int, col int")
    found = positions.definitions_at(points, facts, known.references, known.imports)
    got = {(r["at_line"], r["at_col"]): (r["symbol"], r["reason"], r["target_file"], r["target_line"]) for r in found.collect()}
    b, c = ("B", "resolved", "a.py", 1), ("C", "unresolved", None, None)
    assert got == {(1, 16): b, (2, 3): b, (2, 4): b, (2, 6): c, (3, 1): b, (3, 3): ("C", "external", None, None), (3, 7): ("A", "unresolved", None, None), (4, 1): (None, "no-symbol", None, None)}
    exchanged = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in line]
    assert exchanged and not any("at_col" in line for line in exchanged)
