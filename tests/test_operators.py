"""Operators on small inputs with known results."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from basalt.functions import paths, scoring
from basalt.operators.diff import snapshot_diff
from basalt.operators import graph
from basalt.sources.shared import written
from basalt.operators.graph import longest_levels, reached, strongly_connected
from basalt.operators.search import glob_of, lines_of, search
from basalt.streaming.changes import anchored_windows, bursts, flushed


def files(spark):
    rows = [("src/a.py", "def hello():\n    return 'Hello'\n"), ("src/b.py", "hello()\r\nx = 1\r\n"), ("README.md", "say HELLO\n"), ("empty", ""), ("none", None)]
    return spark.createDataFrame(rows, "file string, text string")


def places(df):
    return [(r["file"], r["line"], r["col"], r["end_col"]) for r in df.collect()]


def test_search_positions_case_and_words(spark):
    f = files(spark)
    assert places(search(f, "hello")) == [("README.md", 1, 5, 10), ("src/a.py", 1, 5, 10), ("src/a.py", 2, 13, 18), ("src/b.py", 1, 1, 6)]
    assert places(search(f, "hello", case_sensitive=True)) == [("src/a.py", 1, 5, 10), ("src/b.py", 1, 1, 6)]
    assert places(search(f, "hell", whole_word=True)) == []
    assert len(places(search(f, "hello", whole_word=True))) == 4
    assert len(places(search(f, "l", max_results=3))) == 3
    assert places(search(f.where("file = 'src/b.py'"), r"x\s*=", regex=True)) == [("src/b.py", 2, 1, 4)]
    assert places(search(f, "a.py")) == []


def test_search_anchors_groups_and_empty_matches(spark):
    df = spark.createDataFrame([("f", "x\nimport y\r\nend\r\np end"), ("g", "aa bb ab"), ("h", "\ue000foo\ue001 foo"), ("i", "")], "file string, text string")
    assert places(search(df, "^import", regex=True)) == [("f", 2, 1, 7)]
    assert places(search(df, "end$", regex=True)) == [("f", 3, 1, 4), ("f", 4, 3, 6)]
    assert places(search(df, r"([ab])\1", regex=True)) == [("g", 1, 1, 3), ("g", 1, 4, 6)]
    assert places(search(df, "foo")) == [("h", 1, 2, 5), ("h", 1, 7, 10)]
    assert places(search(df.where("file = 'g'"), "b*", regex=True)) == [("g", 1, 1, 1), ("g", 1, 2, 2), ("g", 1, 3, 3), ("g", 1, 4, 6), ("g", 1, 6, 6), ("g", 1, 7, 7), ("g", 1, 8, 9), ("g", 1, 9, 9)]
    assert places(search(df, r"(?<!\n)\Aimport", regex=True)) == [("f", 2, 1, 7)]
    assert places(search(df, "$", regex=True)) != []
    with pytest.raises(ValueError):
        search(df, "(", regex=True)


def test_search_filters_numbers_and_truncation(spark):
    f = files(spark)
    rows = search(f, "hello", max_results=3).collect()
    assert [(r["match"], r["truncated"]) for r in rows] == [(1, True), (2, True), (3, True)]
    assert [(r["match"], r["truncated"]) for r in search(f, "hello", max_results=4).collect()] == [(k, False) for k in range(1, 5)]
    assert {p[0] for p in places(search(f, "hello", glob="*.py"))} == {"src/a.py", "src/b.py"}
    assert {p[0] for p in places(search(f, "hello", under="src/", only=("src/b.py", "README.md")))} == {"src/b.py"}
    assert search(f, "hello").select("file").distinct().count() == 3


def test_search_globs(spark):
    f = files(spark)
    got = lambda g: {r["file"] for r in f.where(F.col("file").rlike(glob_of(g))).collect()}
    assert got("*.md") == {"README.md"} and got("*.PY") == {"src/a.py", "src/b.py"} and got("src/?.py") == {"src/a.py", "src/b.py"} and got("**/b.py") == {"src/b.py"}


def test_lines_and_columns_outside_the_bmp(spark):
    df = spark.createDataFrame([("f", "😀ab\nc")], "file string, text string")
    assert places(search(df, "b")) == [("f", 1, 4, 5)]
    assert lines_of(df).count() == 2


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.d.ts",), ("Makefile",), (".env",)], "p string")
    p = F.col("p")
    assert [tuple(r) for r in df.select(paths.dirname(p), paths.basename(p), paths.extension(p), paths.ancestors(p)).collect()] == [("a/b", "c.d.ts", ".ts", ["a", "a/b"]), ("", "Makefile", "", []), ("", ".env", "", [])]
    spec = spark.createDataFrame([("@x/y/z",), ("node:fs/promises",)], "s string")
    assert [r[0] for r in spec.select(paths.package_root(F.col("s"))).collect()] == ["@x/y", "node:fs"]


def test_fuzzy_scores(spark):
    df = spark.createDataFrame([("handle_user",), ("handleUser",), ("hu",), ("hub",), ("shut",), ("other",), ("",)], "n string")
    got = [round(r[0], 3) for r in df.select(scoring.fuzzy_score(F.col("n"), "hu")).collect()]
    assert got == [248.9, 249.0, 1000.0, 797.0, 598.6, 0.0, 0.0]


def test_path_scores(spark):
    df = spark.createDataFrame([("src/store.ts",), ("store/x.ts",), ("src/mystore.ts",), ("other.ts",)], "p string")
    got = [round(r[0], 3) for r in df.select(scoring.path_score(F.col("p"), "store", current="src/a.ts", recent=("src/store.ts",))).collect()]
    assert got == [900 - 8 + 20 - 2 + 12 + 3 + 15, 800 - 10 - 2, round(600 - 2 - 1.0 + 20 - 2 + 12 + 3, 3), 0.0]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "file string, size int")
    new = spark.createDataFrame([("b", 3), ("c", None), ("d", 4)], "file string, size int")
    assert {(r["file"], r["status"]) for r in snapshot_diff(old, new, "file", ["size"]).collect()} == {("a", "D"), ("b", "M"), ("c", None), ("d", "A")}


def test_graph_with_fan_out(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("a", "f"), ("f", "g"), ("a", "g"), ("g", "g")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdefgh"], "node string")
    assert {(r["node"], r["component"]) for r in strongly_connected(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")}
    assert {r["node"]: r["level"] for r in longest_levels(edges, nodes).collect()} == {"h": 0, "g": 0, "c": 0, "d": 0, "e": 0, "f": 1, "a": 2, "b": 2}
    assert {(r["node"], r["depth"]) for r in reached(edges, nodes.where("node = 'a'"), depth=2).collect()} == {("b", 1), ("f", 1), ("g", 1), ("c", 2)}
    assert strongly_connected(edges.limit(0)).count() == 0


def test_anchored_windows_do_not_slide(spark):
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    df = spark.createDataFrame([("f", at(0), 1), ("f", at(20), 2), ("f", at(31), 3), ("f", at(60), 4)], "file string, ts timestamp, id long")
    assert sorted((r["n"], r["last_event"]) for r in anchored_windows(df, "file", "ts", "id", 30).collect()) == [(2, 2), (2, 4)]


def test_bursts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    rows = [("a", at(0), "change", 1), ("a", at(200), "unlink", 2), ("a", at(450), "add", 3), ("a", at(2000), "add", 4), ("b", at(100), "change", 5)]
    priority = "CASE kind WHEN 'unlink' THEN 2 WHEN 'add' THEN 1 ELSE 0 END"
    spark.createDataFrame(rows, "file string, ts timestamp, kind string, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in bursts(table, "file", "ts", "kind", priority, "id").collect()}
    assert {(r[0], r[3]) for r in batch} == {("a", "unlink"), ("a", "add"), ("b", "change")}
    late = spark.createDataFrame([("z", at(60_000), "add", 9)], "file string, ts timestamp, kind string, id long")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = bursts(stream, "file", "ts", "kind", priority, "id", late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    try:
        q.processAllAvailable()
        late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    assert {tuple(r) for r in spark.table("bursts").collect()} == batch


def test_flush_window_keeps_deletions(spark, tmp_path):
    spark.createDataFrame([("a", "deleted"), ("a", "added"), ("b", "changed")], "file string, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, kind string").parquet(str(tmp_path / "in"))
    q = flushed(stream, "file", 30).writeStream.format("memory").queryName("flushed").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(40):
            q.awaitTermination(1)
            if spark.table("flushed").count() == 2:
                break
    finally:
        q.stop()
    assert {tuple(r) for r in spark.table("flushed").collect()} == {("a", "deleted", 2), ("b", "changed", 1)}


def test_long_ways_are_followed_by_doubling(spark, monkeypatch):
    """A tail of 300 into a cycle of 40, a cycle of 3 with a branching node before it, and a chain below a fork, in a bounded number of rounds."""
    rounds = []

    def counted(df, label="step"):
        rounds.append(label)
        return written(df, label)

    monkeypatch.setattr(graph, "written", counted)
    tail = [(k, k + 1) for k in range(1000, 1300)] + [(1300, 100)] + [(k, 100 + (k - 99) % 40) for k in range(100, 140)]
    fork = [(1, 2), (2, 3), (3, 1), (50, 1), (50, 51), (50, 60), (60, 61), (61, 62), (51, 62), (70, 50), (71, 70), (71, 50), (50, 72), (72, 73), (73, 50)]
    edges = spark.createDataFrame(tail + fork, "src int, dst int")
    found = {r["node"]: r["component"] for r in strongly_connected(edges).collect()}
    assert found == {k: 100 for k in range(100, 140)} | {1: 1, 2: 1, 3: 1} | {50: 50, 72: 50, 73: 50}
    nodes = spark.createDataFrame([(n,) for n in {x for e in tail + fork for x in e} | {999}], "node int")
    levels = {r["node"]: r["level"] for r in longest_levels(edges, nodes).collect()}
    assert levels[1000] == 301 and levels[1300] == 1 and levels[100] == 0 and levels[50] == levels[73] == 3 and levels[60] == 2 and levels[70] == 4 and levels[71] == 5 and levels[999] == 0
    assert len(rounds) < 120
