"""Queries over lines and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.folds import Digest, folded
from ..operators.search import by_file, lines_of, search
from .base import Registry, table

R = Registry()

_LINES = "SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS line_text FROM (SELECT doc_id, source, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents)"


def _hits(needle: str, where: str = "TRUE") -> str:
    """All places of a lower-case word in lower-cased lines, as SQL."""
    n = len(needle)
    return f"""
      lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS line_text
                FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE {where})),
      parts AS (SELECT doc_id, line, line_text, string_split(lower(line_text), '{needle}') AS ps FROM lines WHERE strpos(lower(line_text), '{needle}') > 0),
      hits AS (SELECT doc_id, line, line_text, unnest(list_transform(range(1, len(ps)), lambda k: len(array_to_string(ps[1:k], '')) + {n} * (k - 1) + 1)) AS col FROM parts)"""


@R.add(f"WITH {_hits('pathetic')} SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, CAST(col + 8 AS BIGINT) AS end_col, substr(line_text, 1, 400) AS line_text FROM hits ORDER BY doc_id, line, col LIMIT 200")
def q01_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), "pathetic", key="doc_id", max_results=200)
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line", "col", "end_col")], "line_text")


@R.add(f"""WITH lines AS ({_LINES.replace("FROM documents)", "FROM documents WHERE source LIKE 'src1%')")})
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(len(regexp_extract_all(line_text, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')) AS BIGINT) AS hits
FROM lines WHERE regexp_matches(line_text, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')""")
def q02_regex_search_in_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("source").startswith("src1"))
    found = search(docs, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", key="doc_id", regex=True, case_sensitive=True, max_results=None)
    return found.groupBy("doc_id", "line").agg(F.count("*").alias("hits")).select("doc_id", F.col("line").cast("long").alias("line"), "hits")


@R.add(f"""WITH lines AS ({_LINES}) SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(1 AS BIGINT) AS col, CAST(4 AS BIGINT) AS end_col FROM lines WHERE regexp_matches(line_text, '^The\\b') OR regexp_matches(line_text, '^Der\\b')""")
def q51_anchored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), r"^(The|Der)\b", key="doc_id", regex=True, case_sensitive=True, max_results=None)
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line", "col", "end_col")])


@R.add(f"""WITH lines AS ({_LINES}), n AS (SELECT count(*) AS n FROM lines WHERE regexp_matches(line_text, '\\.$'))
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(row_number() OVER (ORDER BY doc_id, line) AS INTEGER) AS match, (SELECT n FROM n) > 100 AS truncated FROM lines WHERE regexp_matches(line_text, '\\.$') ORDER BY doc_id, line LIMIT 100""")
def q51_numbered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), r"\.$", key="doc_id", regex=True, case_sensitive=True, max_results=100)
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "match", "truncated")


@R.add(f"""WITH {_hits('stupid')}
SELECT doc_id, CAST(count(*) AS BIGINT) AS hits, CAST(min(line) AS BIGINT) AS first_line, string_agg(DISTINCT CAST(line AS VARCHAR), ',' ORDER BY line) AS hit_lines FROM hits GROUP BY doc_id""".replace("string_agg(DISTINCT CAST(line AS VARCHAR), ',' ORDER BY line)", "array_to_string(list_sort(list_distinct(list(line))), ',')"))
def q03_hits_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_file(search(table(spark, sf_dir, "documents"), "stupid", key="doc_id", max_results=None), "doc_id")
    return found.withColumn("first_line", F.col("first_line").cast("long"))


@R.add(f"""WITH lines AS ({_LINES}),
dens AS (SELECT doc_id, CAST(floor((line - 1) / 20) AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE regexp_full_match(line_text, '[ \\t]*')) AS BIGINT) AS blank,
         CAST(sum(len(line_text)) AS BIGINT) AS chars FROM lines GROUP BY ALL),
ranked AS (SELECT doc_id, CAST(floor((line - 1) / 20) AS BIGINT) AS segment, line, row_number() OVER (PARTITION BY doc_id, floor((line - 1) / 20) ORDER BY len(line_text) DESC, line) AS r FROM lines)
SELECT d.*, array_to_string(list(r.line ORDER BY r.r), ',') AS longest FROM dens d JOIN ranked r ON d.doc_id = r.doc_id AND d.segment = r.segment AND r.r <= 3 GROUP BY ALL""")
def q17_density_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(table(spark, sf_dir, "documents"), "doc_id").withColumn("segment", F.floor((F.col("line") - 1) / 20))
    order = Window.partitionBy("doc_id", "segment").orderBy(F.desc(F.char_length("line_text")), "line")
    ranked = lines.withColumn("r", F.row_number().over(order))
    top = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "line"))))
    return ranked.groupBy("doc_id", "segment").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("line_text").rlike(r"^[ \t]*$")).alias("blank"), F.sum(F.char_length("line_text")).cast("long").alias("chars"),
        F.array_join(F.transform(top, lambda s: s["line"].cast("string")), ",").alias("longest"),
    )


@R.add("""SELECT lang, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS tests, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS line_count
FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY lang""")
def q08_language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sized = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.size(F.split("text", "\n")).alias("line_count"))
    return sized.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("files"), F.count_if(F.col("toxic") == 1).alias("tests"), F.sum("bytes").cast("long").alias("bytes"), F.sum("line_count").cast("long").alias("line_count"))


_TABLES = ("customer", "documents", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@R.add(" UNION ALL ".join(f"SELECT '{t}' AS entity, CAST(count(*) AS BIGINT) AS n FROM {t}" for t in _TABLES))
def q09_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("entity"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add("""SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS dir, regexp_extract(url, '[^/]*$', 0) AS base, lower(regexp_extract(regexp_extract(url, '[^/]*$', 0), '^.+(\\.[^.]*)$', 1)) AS ext FROM pages""")
def q06_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.paths import basename, dirname, extension

    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", dirname(url).alias("dir"), basename(url).alias("base"), extension(url).alias("ext"))


@R.add("""SELECT host, CAST(count(*) AS BIGINT) AS inbound, CAST(count(DISTINCT page_id) AS BIGINT) AS files FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?]+)', 1) AS host FROM pages)
GROUP BY host ORDER BY files DESC, inbound DESC, host LIMIT 20""")
def q16_top_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?]+)", 1).alias("host"))
    return hosts.groupBy("host").agg(F.count("*").alias("inbound"), F.count_distinct("page_id").alias("files")).orderBy(F.desc("files"), F.desc("inbound"), "host").limit(20)


@R.add("""SELECT page_id, CAST(len(hs) AS BIGINT) AS n_hrefs, array_to_string(hs, ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages)""")
def q42_html_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("hs"))
    return found.select("page_id", F.size("hs").cast("long").alias("n_hrefs"), F.array_join("hs", " ").alias("hrefs"))


@R.add("""SELECT source, sha1(string_agg(CAST(doc_id AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR), chr(10) ORDER BY doc_id)) AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source""")
def q50_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over sorted rows is a chain by nature: each source's ids and sizes pass through one task, which holds only the digest."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat_ws(":", "doc_id", "n_chars").alias("text"))
    return folded(rows, ["source"], ["doc_id"], Digest, "fingerprint string, n long")


@R.add("""SELECT k AS json_key, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT v) AS BIGINT) AS values_n FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events) GROUP BY k""")
def q41_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("json_key", "v"))
    return pairs.groupBy("json_key").agg(F.count("*").alias("n"), F.count_distinct("v").alias("values_n"))


_FILES = (
    ("sql", "CREATE TABLE Sup_{k} (\n  id int\n);\ncreate or replace view active.\"V{k}\" AS SELECT 1 FROM Sup_{k};\n-- create table no\nCREATE UNIQUE INDEX idx_{k} ON sup_{k} (id);"),
    ("ini", "[main {k}]\nname_{k} = x\nHOME: {k}\n; note=1\n[other]"),
    ("dockerfile", "FROM node:20 AS build{k}\nARG V{k}=1\n# ARG NO=1\nRUN make"),
    ("toml", "top{k} = 1\n[tool.\"x\"]\n'key {k}' = 2"),
    ("yaml", "jobs{k}:\n  - name: x\n# no: 1\nurl: http://a"),
    ("shell", "PORT{k}=1\nrun{k}() {\n  local x{k}=2\n}\nsource ./lib.sh"),
    ("css", ".card{k}, #main{k}:hover {\n  --gap{k}: .5em;\n}"),
    ("html", "<p id=\"a{k}\"><b class=x id='b{k}'>"),
    ("markdown", "# Title {k} #\n```\n# no\n```\n## Two"),
)
#: What the files define: language, line, kind, name before and after the key (none where it has none), container.
_DEFINED = (
    ("sql", 1, "struct", "sup_", "", None), ("sql", 4, "interface", "active.V", "", None), ("sql", 6, "property", "idx_", "", None), ("ini", 1, "namespace", "main ", "", None), ("ini", 2, "field", "name_", "", None),
    ("ini", 3, "constant", "HOME", None, None), ("ini", 5, "namespace", "other", None, None), ("dockerfile", 1, "namespace", "build", "", None), ("dockerfile", 2, "variable", "V", "", None), ("toml", 1, "field", "top", "", None),
    ("toml", 2, "namespace", 'tool."x"', None, None), ("toml", 3, "field", "key ", "", 'tool."x"'), ("yaml", 1, "field", "jobs", "", None), ("yaml", 2, "field", "name", None, None), ("yaml", 4, "field", "url", None, None),
    ("shell", 1, "variable", "PORT", "", None), ("shell", 2, "function", "run", "", None), ("shell", 3, "variable", "x", "", None), ("css", 1, "class", "card", "", None), ("css", 1, "constant", "main", "", None),
    ("css", 2, "variable", "--gap", "", None), ("html", 1, "constant", "a", "", None), ("html", 1, "constant", "b", "", None), ("markdown", 1, "namespace", "Title ", "", None), ("markdown", 5, "namespace", "Two", None, None),
)


def _line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, lang, text): nine small files for each supplier."""
    kinds = F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(text).alias("text")) for lang, text in _FILES])
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(kinds).alias("f"))
    return rows.select(F.concat_ws(".", "k", "f.lang").alias("file"), "f.lang", F.replace("f.text", F.lit("{k}"), F.col("k").cast("string")).alias("text"))


_text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v + "'"


@R.add("SELECT s_suppkey || '.' || d.lang AS file, CAST(d.line AS INTEGER) AS line, d.kind AS kind, CASE WHEN d.after IS NULL THEN d.name ELSE d.name || s_suppkey || d.after END AS name, d.container AS container FROM supplier, (VALUES " + ", ".join(f"({_text(a)}, {b}, {_text(c)}, {_text(d)}, {_text(e)}, {_text(f)})" for a, b, c, d, e, f in _DEFINED) + ") AS d(lang, line, kind, name, after, container)")
def q43_line_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.line_facts import line_definitions

    return line_definitions(_line_files(spark, sf_dir)).drop("col")


@R.add("SELECT s_suppkey || '.sql' AS file, CAST(4 AS INTEGER) AS line, CAST(52 + len(CAST(s_suppkey AS VARCHAR)) AS INTEGER) AS col, 'sup_' || s_suppkey AS name FROM supplier UNION ALL SELECT s_suppkey || '.sql', CAST(6 AS INTEGER), CAST(29 + len(CAST(s_suppkey AS VARCHAR)) AS INTEGER), 'sup_' || s_suppkey FROM supplier")
def q43_sql_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.line_facts import sql_references

    return sql_references(_line_files(spark, sf_dir)).select("file", "line", "col", "name")


@R.add("""SELECT p_partkey, CAST(p_partkey % 5 = 0 OR p_partkey % 5 = 1 AS BOOLEAN) AS test, p_partkey % 5 = 2 AS doc, CASE p_partkey % 5 WHEN 3 THEN 'groovy' END AS manifest, p_partkey % 5 = 4 AS entry FROM part""")
def q77_file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths say, over a path made for each part."""
    from ..functions import roles

    k = F.col("p_partkey")
    folder = F.concat(F.lit("pkg"), k.cast("string"), F.lit("/"))
    path = F.concat(folder, F.element_at(F.array(*map(F.lit, ("tests/a.py", "b.spec.ts", "Readme.md", "build.gradle", "main.go"))), (k % 5 + 1).cast("int")))
    made = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    at = F.col("path")
    return made.select("p_partkey", roles.is_test(at).alias("test"), roles.is_doc_or_config(at).alias("doc"), roles.manifest_language(at).alias("manifest"), roles.has_entry_name(at).alias("entry"))
