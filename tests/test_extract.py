"""Extractors by language: a language of one's own, deadlines, and failures that stay with their file."""

from __future__ import annotations

import sys
import types

from basalt.sources.extract import budget, discovered, extracted, rows_of
from basalt.sources.python_facts import python_facts


def language_of_labels():
    """Made inside a function, so that it travels to the workers by value."""

    def labels(file, text):
        """A language of lines like ``label:``."""
        for n, line in enumerate(text.split("\n"), 1):
            if line == "loop":
                while True:
                    pass
            if line == "boom":
                raise KeyError("no such thing")
            if line.endswith(":"):
                yield {"fact": "def", "kind": "namespace", "name": line[:-1], "line": n, "scope": f"{file}#0", "binds": True}

    return labels


FILES = [("a.lab", "lab", "one:\nx\ntwo:"), ("slow.lab", "lab", "three:\nloop"), ("bad.lab", "lab", "boom"), ("p.py", "python", "x = 1\n"), ("broken.py", "python", "def ("), ("n.lab", "lab", None), ("other.txt", "plaintext", "four:")]


def test_a_language_of_ones_own_beside_python(spark):
    files = spark.createDataFrame(FILES, "rel string, lang string, text string").repartition(2)
    rows = extracted(files, {"lab": language_of_labels()}, seconds=1.0).collect()
    assert {(r["file"], r["name"], r["line"]) for r in rows if r["kind"] == "namespace"} == {("a.lab", "one", 1), ("a.lab", "two", 3)}
    assert {(r["file"], r["kind"]) for r in rows if r["fact"] == "error"} == {("slow.lab", "timeout"), ("bad.lab", "extractor-failed"), ("broken.py", "parse-failed")}
    own = lambda rs: {(r["fact"], r["name"], r["ord"]) for r in rs if r["file"] == "p.py"}
    assert own(rows) == own(python_facts(files).collect()) and not [r for r in rows if r["file"] in ("n.lab", "other.txt")]


def test_budgets_and_rows():
    assert budget("x" * 1000) is None and budget("x" * 65536) == 1.0 + 64 * 0.0015 and budget("x" * 10**8) == 10.0
    assert rows_of(lambda f, t: [{"fact": "def", "nonsense": 1}], "f", "")[0]["kind"] == "parse-failed"
    assert rows_of(lambda f, t: [{"fact": "def"}, {"fact": "ref"}], "f", "") == [{"file": "f", "ord": 0, "fact": "def"}, {"file": "f", "ord": 1, "fact": "ref"}]


def test_modules_that_fail_are_told_apart():
    good, bad = types.ModuleType("good_language"), types.ModuleType("bad_language")
    labels = language_of_labels()
    good.LANGUAGE, good.extract, bad.LANGUAGE = "lab", labels, "x"
    sys.modules |= {"good_language": good, "bad_language": bad}
    found, wrong = discovered(["good_language", "bad_language", "missing_language"])
    assert found == {"lab": labels} and set(wrong) == {"bad_language", "missing_language"} and "AttributeError" in wrong["bad_language"]
