"""Declared types in three styles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basalt.functions.signatures import signature, signature_parts, split_outside


@pytest.mark.parametrize("style,line,params,result", [
    ("colon", "def f(self, a: int, b: Dict[str, List[int]] = {}, *rest: str, c=')', **kw: Any) -> Optional[Dict[str, int]]:", [("a", "int"), ("b", "Dict[str, List[int]]"), ("rest", "str"), ("kw", "Any")], "Optional[Dict[str, int]]"),
    ("colon", "async run(x: (a: number) => void, ...ys: string[]): Promise<Map<string, number>> {", [("x", "(a: number) => void"), ("ys", "string[]")], "Promise<Map<string, number>>"),
    ("colon", "const g = (a: string = \"x,y\", b) => number", [("a", "string")], "number"),
    ("colon", "def broken(a: int", [], None), ("colon", "", [], None), ("colon", "x = 1", [], None),
    ("go", "func (r *Repo) Do(ctx context.Context, f func(int) error, n) (string, error) {", [("ctx", "context.Context"), ("f", "func(int) error")], "(string, error)"),
    ("go", "func Main()", [], None),
    ("java", "@Override public static final Map<String, List<Integer>> get(@Nullable String a, final int[] b, Map<K, V> m) {", [("a", "String"), ("b", "int[]"), ("m", "Map<K, V>")], "Map<String, List<Integer>>"),
    ("java", "public Repo(String root) {", [("root", "String")], None),
])
def test_signatures(style, line, params, result):
    assert signature(line, style) == (params, result)


def test_splitting_outside_brackets_and_quotes():
    assert split_outside("a, (b, c), 'd, e', f<g, h>, i >= 1, j") == ["a", " (b, c)", " 'd, e'", " f<g, h>", " i >= 1", " j"] and split_outside("") == [""]


def test_as_a_column(spark):
    df = spark.createDataFrame([("def f(a: int) -> str:",), (None,), ("no",)], "line string").repartition(1)
    got = [(r["s"]["params"], r["s"]["result"]) for r in df.select(signature_parts(F.col("line"), "colon").alias("s")).collect()]
    assert got.count(([], None)) == 2 and ([("a", "int")], "str") in [([tuple(p) for p in ps], r) for ps, r in got]
