"""Imports, references, types, calls and the file graph of small trees of Python files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basalt.operators import codemap
from basalt.operators.resolve import absolute, module_names, resolve_imports, resolve_references
from basalt.sources.python_facts import python_facts

TREE = {
    "src/app/__init__.py": "from .models import User\nfrom .loop_a import ghost\n",
    "src/app/models.py": 'class Base:\n    """A base."""\n    kind = "base"\n    def save(self, when):\n        return self.kind\n\n\nclass User(Base):\n    def __init__(self, name):\n        self.name = name\n        self.home = Address(name)\n    def save(self, when):\n        return when\n\n\nclass Address:\n    def show(self):\n        return 1\n',
    "src/app/loop_a.py": "from .loop_b import ghost\n",
    "src/app/loop_b.py": "from .loop_a import ghost\n",
    "src/app/helpers.py": "def help_me(when):\n    return when\n\n\ndef _hidden():\n    return [w for w in range(3) if w]\n",
    "src/app/views.py": "from app import User\nfrom app import models\nfrom .helpers import *\nimport app.helpers as tools\nimport numpy as np\nfrom app.models import Nobody\nfrom . import helpers\n\n\ndef view(when, user: User):\n    made = User('x')\n    made.save(when)\n    user.home.show()\n    models.Address().show()\n    help_me(when)\n    tools.help_me(np.array([when]))\n    helpers._hidden()\n    return unknown + made.kind\n",
    "tests/test_views.py": "from app.views import view\n\n\ndef test_view():\n    assert view(1, None)\n",
    "main.py": "from app.views import view\n\nif True:\n    view(2, None)\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    return python_facts(spark.createDataFrame([(f, t, "python") for f, t in TREE.items()], "rel string, text string, lang string")).persist()


@pytest.fixture(scope="module")
def imports(facts):
    return resolve_imports(facts)


@pytest.fixture(scope="module")
def references(facts):
    return resolve_references(facts).persist()


def test_module_names_and_relative_imports(spark):
    files = spark.createDataFrame([("src/app/__init__.py",), ("src/app/a.py",), ("x.txt",), ("top.py",)], "file string")
    assert {tuple(r) for r in module_names(files).collect()} == {("src.app", "src/app/__init__.py"), ("app", "src/app/__init__.py"), ("src.app.a", "src/app/a.py"), ("app.a", "src/app/a.py"), ("top", "top.py")}
    df = spark.createDataFrame([("a/b/c.py", ".x"), ("a/b/c.py", "..x.y"), ("a/b/c.py", "."), ("a/b/c.py", "q"), ("c.py", ".x")], "f string, m string")
    assert [r[0] for r in df.select(absolute(F.col("f"), F.col("m"))).collect()] == ["a.b.x", "a.x.y", "a.b", "q", "x"]


def test_imports_through_packages_and_cycles(facts, imports):
    names = {(r["file"], r["ord"]): r["name"] for r in facts.where("fact = 'def'").collect()}
    got = {(r["file"], r["name"]): (r["outcome"], r["target_file"], names.get((r["target_file"], r["target_ord"]))) for r in imports.collect()}
    views = "src/app/views.py"
    assert got[views, "User"] == ("def", "src/app/models.py", "User") and got[views, "models"] == ("module", "src/app/models.py", None)
    assert got[views, "*"] == ("module", "src/app/helpers.py", None) and got[views, "tools"] == ("module", "src/app/helpers.py", None) and got[views, "helpers"] == ("module", "src/app/helpers.py", None)
    assert got[views, "np"][0] == "external" and got[views, "Nobody"][0] == "missing" and got["src/app/__init__.py", "ghost"][0] == "missing"
    assert got["main.py", "view"] == ("def", views, "view")


def test_references_through_chains(facts, references):
    where = {(r["file"], r["ord"]): (r["file"].split("/")[-1], r["line"]) for r in facts.where("fact = 'def'").collect()}
    got = {(r["line"], r["name"]): (r["outcome"], where.get((r["target_file"], r["target_ord"]))) for r in references.where("file = 'src/app/views.py'").collect()}
    assert got[11, "User"] == ("def", ("models.py", 8)) and got[12, "save"] == ("def", ("models.py", 12)) and got[13, "home"] == ("def", ("models.py", 11))
    assert got[13, "show"] == ("def", ("models.py", 17)) and got[15, "help_me"] == ("def", ("helpers.py", 1)) and got[16, "help_me"] == ("def", ("helpers.py", 1))
    assert got[17, "_hidden"] == ("def", ("helpers.py", 5)) and got[16, "np"][0] == "external" and got[18, "unknown"][0] == "unresolved"
    assert got[18, "kind"] == ("def", ("models.py", 3)) and got[14, "models"][0] == "module"
    assert {r["outcome"] for r in codemap.coverage(references).collect()} == {"def", "module", "external", "unresolved"}


def test_file_graph_and_overview(facts, imports, references):
    edges = codemap.file_edges(imports, references)
    got = {(r["src"], r["dst"]): (r["imports"], r["refs"]) for r in edges.collect()}
    assert got["main.py", "src/app/views.py"] == (1, 1) and got["src/app/views.py", "src/app/helpers.py"] == (3, 3) and got["src/app/__init__.py", "src/app/models.py"] == (1, 0)
    files = facts.where("fact = 'scope' and parent is null").select("file")
    degree = {r["file"]: tuple(r)[1:] for r in codemap.degrees(edges, files).collect()}
    assert degree["main.py"] == (0, 1, 0, 2) and degree["src/app/models.py"][0] == 2
    first = [(r["file"], r["kind"], r["score"], r["reasons"]) for r in codemap.start_here(codemap.degrees(edges, files), facts).collect()]
    assert first[0] == ("main.py", "entry", 1000, ["name"]) and first[1][1:3] == ("hot", 2) and len(first) == 7 and "tests/test_views.py" not in {f[0] for f in first}
    assert {r["file"]: r["layer"] for r in codemap.layers(codemap.degrees(edges, files)).collect()}["src/app/models.py"] == "infra"
    assert {r["dir"]: r["files"] for r in codemap.subtree_counts(files).collect()} == {"": 8, "src": 6, "src/app": 6, "tests": 1}
    assert [(r["name"], r["dir"], r["files"]) for r in codemap.listing(files, "").collect()] == [("src", True, 6), ("tests", True, 1), ("main.py", False, 1)]
    assert [r["name"] for r in codemap.listing(files, "src/app").collect()] == ["__init__.py", "helpers.py", "loop_a.py", "loop_b.py", "models.py", "views.py"]
    assert [tuple(r) for r in codemap.external_packages(imports).collect()] == [("numpy", 1, 1)]
    by = {r["file"]: r for r in codemap.file_facts(facts).collect()}
    assert (by["src/app/models.py"]["functions"], by["src/app/models.py"]["exports"], by["src/app/helpers.py"]["exports"], by["src/app/helpers.py"]["branches"]) == (4, 3, 1, 1)


def test_calls_types_trees_and_flow(facts, imports, references):
    calls = {(r["caller"], r["callee"]): r["calls"] for r in codemap.call_edges(facts, references).collect()}
    assert calls["view", "save"] == 1 and calls["view", "show"] == 1 and calls["view", "help_me"] == 2 and calls["<module>", "view"] == 1 and calls["__init__", "Address"] == 1
    assert {tuple(r) for r in codemap.ancestors_of_types(facts, imports).collect()} == {("src/app/models.py:User", "src/app/models.py:Base", 1)}
    assert {tuple(r) for r in codemap.implementations(facts, imports).collect()} == {("src/app/models.py:Base", "save", "src/app/models.py:User")}
    paths = {r["path"]: (r["kind"], r["depth"]) for r in codemap.definition_paths(facts).where("file = 'src/app/models.py'").collect()}
    assert paths["Base"] == ("class", 0) and paths["Base.save"] == ("method", 1) and paths["User.__init__"] == ("constructor", 1) and paths["Base.kind"] == ("variable", 1)
    flow = {(r["callee"], r["name"]): r["calls"] for r in codemap.argument_flow(facts, references).collect()}
    assert flow == {("save", "when"): 1, ("help_me", "when"): 2}
    uses = {r["name"]: (r["uses"], r["files"]) for r in codemap.reference_counts(facts, references).where("file = 'src/app/views.py'").collect()}
    assert uses["view"] == (2, 2)


def test_facts_of_scopes_and_documents(spark):
    source = 'X = 1\ndef f(a: int) -> str:\n    """First.\n\n    More."""\n    global X\n    X = 2\n    g = lambda y: y + a\n    return g\n\x0c\nclass C(f.B):\n    @property\n    def p(self):\n        return self.q\n'
    rows = python_facts(spark.createDataFrame([("a.py", source, "python")], "rel string, text string, lang string")).collect()
    defs = {(r["name"], r["line"]): r for r in rows if r["fact"] == "def"}
    assert defs["f", 2]["doc"] == "First." and defs["f", 2]["type_name"] == "str" and defs["a", 2]["type_name"] == "int"
    assert defs["X", 7]["scope"] == "a.py#0" and defs["C", 11]["bases"] == ["f.B"] and defs["p", 13]["decorators"] == ["property"] and defs["self", 13]["type_name"] == "C"
    assert defs["y", 8]["scope"] != defs["g", 8]["scope"] and {r["text"] for r in rows if r["fact"] == "literal"} >= {"1", "2"}
