"""The fact store: after adds, changes, deletes and subtree deletes it equals a rebuild, and touches only what changed."""

from __future__ import annotations

import datetime

import pytest

from basalt.sources.python_facts import python_facts
from basalt.streaming.upsert import FactStore

T = datetime.datetime(2024, 1, 1)
SCHEMA = "rel string, change string, text string, size long, mtime timestamp, ord long"


def change(rel, text, ord_, kind="upsert"):
    return (rel, kind, text, None if text is None else len(text), T, ord_)


def rebuilt(spark, files):
    return {tuple(r[:6]) for r in python_facts(spark.createDataFrame([(f, t, "python") for f, t in files.items()], "rel string, text string, lang string")).select("file", "fact", "name", "kind", "line", "ord").collect()}


def held(store):
    return {tuple(r[:6]) for r in store.facts().select("file", "fact", "name", "kind", "line", "ord").collect()}


@pytest.fixture()
def store(spark, tmp_path):
    return FactStore(spark, str(tmp_path / "store"), buckets=8)


def test_batches_equal_a_rebuild(spark, store):
    files = {f"pkg/m{i}.py": f"def f{i}(x):\n    return x + {i}\n" for i in range(20)} | {f"old/n{i}.py": "y = 1\n" for i in range(5)}
    store.apply(spark.createDataFrame([change(f, t, i) for i, (f, t) in enumerate(files.items())], SCHEMA), 0)
    assert held(store) == rebuilt(spark, files) and store.entries().count() == 25
    before = store.places()
    edits = [change("pkg/m1.py", "a = 1\n", 1), change("pkg/m1.py", "b = 2\n", 2), change("new.py", "z = 3\n", 3), change("pkg/m2.py", None, 4, "delete")]
    store.apply(spark.createDataFrame(edits, SCHEMA), 1)
    files |= {"pkg/m1.py": "b = 2\n", "new.py": "z = 3\n"}
    files.pop("pkg/m2.py")
    assert held(store) == rebuilt(spark, files)
    after = store.places()
    touched = {b for b in after if after[b] == 1}
    assert 1 <= len(touched) <= 3 and all(after[b] == before[b] for b in before if b not in touched)
    # a folder goes, but for what is written later
    store.apply(spark.createDataFrame([change("old/n1.py", "k = 1\n", 1), change("old", None, 2, "delete"), change("old/n2.py", "q = 4\n", 3)], SCHEMA), 2)
    files = {f: t for f, t in files.items() if not f.startswith("old/")} | {"old/n2.py": "q = 4\n"}
    assert held(store) == rebuilt(spark, files) and {r["rel"] for r in store.entries().collect()} == set(files)
    store.apply(spark.createDataFrame([change("never.py", "q = 4\n", 1)], SCHEMA), 2)  # the same batch again
    assert held(store) == rebuilt(spark, files)
    store.compact(3)
    assert held(store) == rebuilt(spark, files) and set(store.places().values()) == {3}


def test_reconciling_with_a_scan(spark, store):
    store.apply(spark.createDataFrame([change("a.py", "a = 1\n", 0), change("b.py", "b = 1\n", 1), change("c.txt", "no code", 2)], SCHEMA), 0)
    scan = spark.createDataFrame([("a.py", "a = 1\n", 6, T), ("b.py", "b = 22\n", 7, T), ("d.py", "d = 1\n", 6, T)], "rel string, text string, size long, mtime timestamp")
    found = store.reconcile(scan, 1)
    assert {tuple(r) for r in found.collect()} == {("b.py", "changed"), ("c.txt", "deleted"), ("d.py", "added")}
    assert held(store) == rebuilt(spark, {"a.py": "a = 1\n", "b.py": "b = 22\n", "d.py": "d = 1\n"})
    assert store.differences(scan).isEmpty()


def test_following_a_stream(spark, store, tmp_path):
    source = str(tmp_path / "changes")
    spark.createDataFrame([change("a.py", "a = 1\n", 0), change("b/c.py", "b = 1\n", 1)], SCHEMA).write.parquet(source)
    run = lambda: store.follow(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "progress")).awaitTermination()
    run()
    spark.createDataFrame([change("b", None, 2, "delete")], SCHEMA).write.mode("append").parquet(source)
    run()
    assert held(store) == rebuilt(spark, {"a.py": "a = 1\n"})
