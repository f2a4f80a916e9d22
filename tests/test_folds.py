"""Ordered folds, outlines as trees, compacted file trees and coloured spans."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from basalt.operators.filetree import chain_ends, compacted, visible
from basalt.operators.folds import Digest, Greedy, folded, nested
from basalt.operators.highlights import spans
from basalt.operators.resolve import resolved
from basalt.operators.search import search
from basalt.sources.outlines import headings, json_keys, outlines, yaml_keys
from basalt.sources.python_facts import python_facts


def test_folds_hold_a_state_across_batches(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), a, a + rng.randrange(9), k) for k, a in enumerate(rng.randrange(3000) for _ in range(3000))]
    df = spark.createDataFrame(rows, "k long, a long, b long, id long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {tuple(r) for r in folded(df, ["k"], ["a", "id"], lambda: Greedy(1), "id long", size=64).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, upto = set(), {}
    for k, a, b, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if a >= upto.get(k, -1):
            upto[k] = b
            want.add((k, i))
    assert got == want
    assert folded(df.limit(0), ["k"], ["a"], lambda: Greedy(1), "id long").count() == 0
    digests = folded(spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), (None, 1, None)], "k string, o int, text string"), ["k"], ["o"], Digest, "digest string, n long")
    assert {(r["k"], r["n"]) for r in digests.collect()} == {("s", 2), (None, 1)}


def test_nearest_smaller_levels(spark):
    rows = [("f", i, lv, f"n{i}") for i, lv in enumerate([3, 1, 2, 5, 5, 3, 1])] + [("g", 0, 0, "x")]
    got = {(r["file"], r["place"]): (r["parent"], r["depth"], r["path"]) for r in nested(spark.createDataFrame(rows, "file string, place int, level int, name string"), ["file"], "place", "level", "name").collect()}
    assert got["f", 0] == (None, 0, ["n0"]) and got["f", 3] == (2, 2, ["n1", "n2", "n3"]) and got["f", 4] == (2, 2, ["n1", "n2", "n4"]) and got["f", 5] == (2, 2, ["n1", "n2", "n5"]) and got["f", 6] == (None, 0, ["n6"])


def test_readers_of_outlines(spark):
    assert list(headings("Title\n=====\n\n~~~\n# no\n~~~\n####### no\n#no\n## A ##\n\nB\n-\n| a |\n---\n")) == [(1, 1, "Title"), (9, 2, "A"), (11, 2, "B")]
    assert list(yaml_keys("a:\n  b: >-\n    c: no\n\n    d: no\n  'e f': 1\n- g: {h: 1}\nhttp://x\ni: http://y # z: no\n")) == [(1, 0, "a"), (2, 2, "b"), (6, 2, "e f"), (7, 2, "g"), (9, 0, "i")]
    assert list(json_keys('{"a": {"b": [1, "c", {"d": 1}]},\n/* "x": 1\n */ "e\\"f": ":"}')) == [(1, 1, "a"), (1, 2, "b"), (1, 4, "d"), (3, 1, 'e\\"f')]
    files = spark.createDataFrame([("x.md", "markdown", "# A\n## B\n"), ("y", "markdown", None), ("z.py", "python", "# A")], "file string, lang string, text string")
    assert [(r["name"], r["parent"], r["path"]) for r in outlines(files).orderBy("place").collect()] == [("A", None, ["A"]), ("B", 0, ["A", "B"])]


def test_chains_of_single_folders(spark):
    files = spark.createDataFrame([("a/b/c/d/x.py",), ("a/b/c/d/y.py",), ("top.py",), ("e/f/z.py",), ("e/g.py",), ("e/Node/k.py",)], "file string")
    got = {r["path"]: (r["parent"], r["name"], r["kind"], r["files"]) for r in compacted(files).collect()}
    assert got["a/b/c/d"] == ("", "a/b/c/d", "dir", 2) and got["a/b/c/d/x.py"] == ("a/b/c/d", "x.py", "file", 1) and "a/b" not in got
    assert got["e"] == ("", "e", "dir", 3) and got["e/f"] == ("e", "f", "dir", 1) and got["top.py"] == ("", "top.py", "file", 1)
    order = [r["name"] for r in compacted(files, spark.createDataFrame([("e/f",)], "path string")).where("parent = 'e'").orderBy("place").collect()]
    assert order == ["Node", "f", "g.py"]
    assert {r["file"] for r in visible(files, "/E".lower()).collect()} == set() and {r["file"] for r in visible(files, "NODE").collect()} == {"e/Node/k.py"}
    long = spark.createDataFrame([(f"d{i}", f"d{i + 1}" if i < 99 else None) for i in range(100)], "dir string, only string")
    assert {r["end"] for r in chain_ends(long).collect()} == {"d99"}


def test_coloured_spans(spark):
    source = "import os\nfrom m import K\n\n\ndef f(a):\n    b = K(a)\n    return os.path, b.lost, nope, self, print\n"
    facts = python_facts(spark.createDataFrame([("a.py", source, "python"), ("m.py", "class K:\n    pass\n", "python")], "rel string, text string, lang string")).persist()
    got = {(r["line"], r["col"]): (r["length"], r["kind"]) for r in spans(facts, resolved(facts).references).where("file = 'a.py'").collect()}
    assert got == {(5, 5): (1, 0), (5, 7): (1, 2), (6, 5): (1, 0), (6, 9): (1, 0), (6, 11): (1, 2), (7, 12): (2, 1), (7, 15): (4, 1), (7, 21): (1, 0), (7, 29): (4, 2), (7, 41): (5, 1)}


def test_search_loses_no_hit(spark):
    files = spark.createDataFrame([("a", "a\n"), ("b", ""), ("c", "x1\ny"), ("d", "ſtop K"), ("e", "plain")], "file string, text string")
    hits = lambda q, **o: {(r["file"], r["line"]) for r in search(files, q, max_results=None, **o).collect()}
    assert hits("^$", regex=True) == {("a", 2), ("b", 1)} and hits("x[^y]*+$", regex=True) == {("c", 1)}
    assert hits("stop k") == {("d", 1)} and hits("PLAIN") == {("e", 1)} and hits("PLAIN", case_sensitive=True) == set()
    assert hits("(?-i)X", regex=True) == set() and hits("1\\z", regex=True) == {("c", 1)}
