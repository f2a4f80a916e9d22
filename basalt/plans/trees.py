"""Questions about outlines, file trees and coloured names, over files that are made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signatures import signature_parts
from ..operators.filetree import compacted
from ..operators.highlights import spans
from ..sources.outlines import outlines
from .base import Registry, table
from .code import key_of, known_of

R = Registry()

_OUTLINES = (
    ("markdown", "# Top {k} #\n\ntext\n\n### Deep\n## Two\n```\n# no\n```\nUnder {k}\n===\n- item\n---\n#### Last\n"),
    ("yaml", "name: x{k}\non:\n  push:\n    branches: [a]\njobs:\n- id: j{k}\n  steps:\n    - run: |\n        no: 1\n      uses: u\n# no: 2\n\"quoted {k}\": 1\n"),
    ("json", '{\n  "name": "a: {b}",\n  // "no": 1\n  "deps": {"d{k}": "1", "list": [{"in": 1}]},\n  "end": null\n}\n'),
)
#: What the files hold: language, place, line, name (with the key for #), parent, depth.
_HELD = (
    ("markdown", 0, 1, "Top #", None, 0), ("markdown", 1, 5, "Deep", 0, 1), ("markdown", 2, 6, "Two", 0, 1), ("markdown", 3, 10, "Under #", None, 0), ("markdown", 4, 14, "Last", 3, 1),
    ("yaml", 0, 1, "name", None, 0), ("yaml", 1, 2, "on", None, 0), ("yaml", 2, 3, "push", 1, 1), ("yaml", 3, 4, "branches", 2, 2), ("yaml", 4, 5, "jobs", None, 0), ("yaml", 5, 6, "id", 4, 1), ("yaml", 6, 7, "steps", 4, 1),
    ("yaml", 7, 8, "run", 6, 2), ("yaml", 8, 10, "uses", 6, 2), ("yaml", 9, 12, "quoted #", None, 0),
    ("json", 0, 2, "name", None, 0), ("json", 1, 4, "deps", None, 0), ("json", 2, 4, "d#", 1, 1), ("json", 3, 4, "list", 1, 1), ("json", 4, 4, "in", 3, 2), ("json", 5, 5, "end", None, 0),
)

_null = lambda v: "CAST(NULL AS BIGINT)" if v is None else str(v)


@R.add("SELECT s_suppkey AS s, d.lang, CAST(d.place AS BIGINT) AS place, CAST(d.line AS INTEGER) AS line, replace(d.name, '#', CAST(s_suppkey AS VARCHAR)) AS name, d.parent, CAST(d.depth AS INTEGER) AS depth FROM supplier, (VALUES " + ", ".join(f"('{a}', {b}, {c}, '{d}', {_null(e)}, {f})" for a, b, c, d, e, f in _HELD) + ") AS d(lang, place, line, name, parent, depth)")
def q91_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and keys of three small files a supplier, with what they are under."""
    kinds = F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(text).alias("text")) for lang, text in _OUTLINES])
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(kinds).alias("f"))
    files = rows.select(F.concat_ws(".", "k", "f.lang").alias("file"), "f.lang", F.replace("f.text", F.lit("{k}"), F.col("k").cast("string")).alias("text"))
    part = lambda n: F.split_part("file", F.lit("."), F.lit(n))
    return outlines(files).select(part(1).cast("long").alias("s"), part(2).alias("lang"), "place", "line", "name", "parent", "depth")


@R.add("""WITH f AS (SELECT p_partkey AS p, 'b' || (p_partkey % 5) || '/c' AS b, 'd' || (p_partkey % 3) || '/e/f' AS d FROM part)
SELECT '' AS parent, 'a' AS path, 'a' AS name, 'dir' AS kind, CAST(count(*) AS BIGINT) AS files FROM f UNION ALL SELECT 'a', 'a/' || b, b, 'dir', count(*) FROM f GROUP BY b
UNION ALL SELECT 'a/' || b, 'a/' || b || '/' || d, d, 'dir', count(*) FROM f GROUP BY b, d UNION ALL SELECT 'a/' || b || '/' || d, 'a/' || b || '/' || d || '/m' || p || '.py', 'm' || p || '.py', 'file', 1 FROM f""")
def q92_compact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of one file a part, its chains of single folders drawn as one."""
    p = F.col("p_partkey")
    at = F.concat(F.lit("a/b"), (p % 5).cast("string"), F.lit("/c/d"), (p % 3).cast("string"), F.lit("/e/f/m"), p.cast("string"), F.lit(".py"))
    return compacted(table(spark, sf_dir, "part").select(at.alias("file"))).select("parent", "path", "name", "kind", "files")


@R.add("""WITH q AS (SELECT p_partkey AS p, 6 + length(CAST(p_partkey // 2 AS VARCHAR)) AS l1, 6 + length(CAST(p_partkey // 3 AS VARCHAR)) AS l2 FROM part WHERE p_partkey > 0)
SELECT p, CAST(k.col_ AS INTEGER) AS col, CAST(k.len AS INTEGER) AS length, CAST(k.kind AS INTEGER) AS kind FROM q, LATERAL (VALUES (16, l1, 0), (17 + l1, 1, 2), (22 + l1, 3, 0), (26 + l1, l2, 0), (32 + l1 + l2, 4, 0), (40 + l1 + l2, 5, 0)) AS k(col_, len, kind)""")
def q93_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured spans of the line with most names of each file of the generated tree."""
    facts, known = known_of(spark, sf_dir, more=("name_line", "name_col"))
    found = spans(facts, known.references).where("line = 16 and not endswith(file, '/mod0.py')")
    return found.select(key_of(F.col("file")).alias("p"), "col", "length", "kind")


_SIGNATURES = (
    ("colon", "def make{k}(self, a: int, b: Dict[str, List[int]] = {}, *rest: str, c=')') -> Optional[T{k}]:"),
    ("go", "func (r *Repo{k}) Do(ctx context.Context, f func(int) error, n) (T{k}, error) {"),
    ("java", "@Override public static Map<String, List<T{k}>> get{k}(@Nullable String a, final int[] b) {"),
)
#: What the lines declare: style, place, name and type with the key for #; place -1 is the result.
_DECLARED = (
    ("colon", 0, "a", "int"), ("colon", 1, "b", "Dict[str, List[int]]"), ("colon", 2, "rest", "str"), ("colon", -1, "", "Optional[T#]"), ("go", 0, "ctx", "context.Context"), ("go", 1, "f", "func(int) error"), ("go", -1, "", "(T#, error)"),
    ("java", 0, "a", "String"), ("java", 1, "b", "int[]"), ("java", -1, "", "Map<String, List<T#>>"),
)


@R.add("SELECT p_partkey AS p, d.style, CAST(d.place AS INTEGER) AS place, d.name, replace(d.type, '#', CAST(p_partkey AS VARCHAR)) AS type FROM part, (VALUES " + ", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in _DECLARED) + ") AS d(style, place, name, type)")
def q97_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters and results that three lines a part declare, each in its own style."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    out = None
    for style, line in _SIGNATURES:
        found = part.select("p", signature_parts(F.replace(F.lit(line), F.lit("{k}"), F.col("p").cast("string")), style).alias("s"))
        rows = found.select("p", F.posexplode(F.concat(F.col("s.params"), F.array(F.struct(F.lit("").alias("name"), F.col("s.result").alias("type"))))).alias("place", "d"), F.size("s.params").alias("n"))
        rows = rows.select("p", F.lit(style).alias("style"), F.when(F.col("place") == F.col("n"), -1).otherwise(F.col("place")).alias("place"), "d.name", "d.type")
        out = rows if out is None else out.unionByName(rows)
    return out
