"""Scanning, ignore rules, decoding, Python facts and name resolution on small trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import roles
from basalt.operators.resolve import resolve_names
from basalt.sources import ignore, scan
from basalt.sources.python_facts import python_facts


def verdict(spark, paths, **texts):
    df = spark.createDataFrame([(p.rstrip("/"), p.endswith("/")) for p in paths], "rel string, dir boolean")
    return {r["rel"]: (r["ignored"], r["overridden"]) for r in ignore.verdicts(df, ignore.rules(spark, **texts)).collect()}


def test_last_rule_wins_and_directories_cover_what_is_in_them(spark):
    got = verdict(spark, ["a.log", "keep.log", "sub/x.log", "docs/a.txt", "src/docs/a.txt", "gen/", "gen/a.py", "node_modules/x.js", "img/a.PNG", "b.py", "deep/one/two.tmp.txt"], gitignore="*.log\n# note\n!keep.log\n/docs/\ngen/\n", own="!node_modules/\ndeep/*/two.*\n")
    assert got["a.log"][0] and got["sub/x.log"][0] and got["keep.log"] == (False, True)
    assert got["docs/a.txt"][0] and not got["src/docs/a.txt"][0]
    assert got["gen"][0] and got["gen/a.py"][0] and got["node_modules/x.js"][0] and got["img/a.PNG"][0]
    assert not got["b.py"][0] and got["deep/one/two.tmp.txt"][0]


def test_rules_of_directories_leave_files_alone(spark):
    got = verdict(spark, ["build", "build/", "x/build/a.py"], gitignore="")
    assert got["x/build/a.py"][0]


def test_decoding():
    assert scan.decode("é".encode()) == ("é", "utf8")
    assert scan.decode(b"\xef\xbb\xbfa") == ("a", "utf8-bom")
    assert scan.decode("aé".encode("utf-16-le").join([b"\xff\xfe", b""])) == ("aé", "utf16le")
    assert scan.decode("中文注释 ok".encode("gbk")) == ("中文注释 ok", "gbk")
    assert scan.decode("caf\xe9".encode("latin-1")) == ("café", "latin1")


def test_scan_reads_texts_and_names_reasons(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "b.bin").write_bytes(b"ab\x00c")
    (tmp_path / "Dockerfile").write_text("FROM x\n")
    (tmp_path / "zero.py").write_bytes(b"p\x10\x01\xe4")
    rows = {r["rel"]: r for r in scan.texts(scan.entries(spark, str(tmp_path))).collect()}
    assert rows["pkg/a.py"]["text"] == "x = 1\n" and rows["pkg/a.py"]["lang"] == "python" and rows["Dockerfile"]["lang"] == "dockerfile"
    assert rows["pkg/b.bin"]["skip_reason"] == "binary" and rows["pkg/b.bin"]["text"] is None
    assert rows["zero.py"]["skip_reason"] is None and rows["zero.py"]["encoding"] == "latin1"


SOURCE = """import os.path as p
from pkg import helper, other as o
from star import *
x = 1
x = 2
class A:
    x = 3
    def m(self, helper):
        y = x
        return helper + o + p.join(unknown)
def f():
    def g():
        return f, x
    return g
"""


def test_python_facts_and_names(spark):
    files = spark.createDataFrame([("a.py", SOURCE, "python"), ("bad.py", "def (", "python"), ("none.py", None, "python")], "rel string, text string, lang string")
    facts = python_facts(files).persist()
    assert [r["kind"] for r in facts.where("file = 'bad.py'").collect()] == ["parse-failed"]
    kinds = {(r["name"], r["kind"]) for r in facts.where("fact = 'def'").collect()}
    assert {("A", "class"), ("m", "method"), ("f", "function"), ("self", "parameter"), ("x", "variable")} <= kinds
    own = facts.where("file = 'a.py'").select("ord", "line")
    got = resolve_names(facts).join(own.withColumnRenamed("ord", "target").withColumnRenamed("line", "target_line"), "target", "left")
    got = {(r["name"], r["line"]): (r["found"], r["target_line"], r["module"]) for r in got.join(own.withColumnRenamed("ord", "ref_ord"), "ref_ord").collect()}
    assert got["x", 9] == ("def", 5, None) and got["helper", 10] == ("def", 8, None) and got["o", 10] == ("import", 2, "pkg")
    assert got["p", 10] == ("import", 1, "os.path") and got["unknown", 10] == ("star", 3, "star")
    assert got["f", 13] == ("def", 11, None) and got["x", 13] == ("def", 5, None) and got["g", 14] == ("def", 12, None)


def test_columns_count_utf16_units(spark):
    files = spark.createDataFrame([("a.py", "s = '😀'; t = s\n", "python")], "rel string, text string, lang string")
    row = python_facts(files).where((F.col("fact") == "ref") & (F.col("name") == "s")).first()
    assert (row["line"], row["col"], row["end_col"]) == (1, 15, 16)


def test_roles_of_paths(spark):
    paths = ["tests/a.py", "src/test_x.py", "a.spec.ts", "FooTest.java", "contest.py", "README", "a.rst", "src/main.py", "Index.d.ts", "img/A.PNG", "requirements-dev.txt", "go.mod", "x.csproj", "Gemfile", "src/a.conf", "Containerfile", "latest.js"]
    c = F.col("p")
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = df.select("p", roles.is_test(c).alias("test"), roles.is_doc_or_config(c).alias("doc"), roles.is_binary_name(c).alias("bin"), roles.manifest_language(c).alias("m"), scan.language(c).alias("lang"), roles.entry_reasons(c, F.array(F.lit("latest.js"))).alias("entry")).collect()
    of = lambda k: {r["p"] for r in rows if r[k]}
    assert of("test") == {"tests/a.py", "src/test_x.py", "a.spec.ts", "FooTest.java"} and of("doc") == {"README", "a.rst", "requirements-dev.txt", "src/a.conf"} and of("bin") == {"img/A.PNG"}
    assert {r["p"]: r["m"] for r in rows if r["m"]} == {"requirements-dev.txt": "pip", "go.mod": "gomod", "x.csproj": "xml", "Gemfile": "ruby"}
    assert {r["p"]: r["entry"] for r in rows if r["entry"]} == {"src/main.py": ["name"], "Index.d.ts": ["name"], "latest.js": ["declared"]}
    assert {r["lang"] for r in rows if r["p"] in ("src/a.conf", "Containerfile")} == {"ini", "dockerfile"}
