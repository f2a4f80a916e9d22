"""Definitions and references of languages that are read line by line, with SQL functions alone: no parser, no Python.

Lines are independent of each other but for Markdown's fences and the tables of TOML. So keys inside block scalars of YAML and
triple-quoted strings of TOML count like others, selectors of CSS are found up to the brace or comma in their line, and
underlined headings of Markdown aren't found. Null and empty texts define nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import utf16_length
from ..operators.search import lines_of, match_spans

#: Fixed patterns: the kind of a definition and the pattern whose first group is its name. The first that fits a line counts.
FIRST = {
    "ini": (("namespace", r"^\s*\[([^\]\r\n]+)\]"), ("constant", r"^\s*(?:export\s+)?([A-Z][A-Z0-9_]*)\s*[=:]"), ("field", r"^\s*(?:export\s+)?([A-Za-z_][\w.-]*)\s*[=:]")),
    "dockerfile": (("namespace", r"(?i)^\s*FROM\s+\S+\s+AS\s+([A-Za-z0-9_.-]+)"), ("variable", r"^\s*(?:ARG|ENV)\s+([A-Za-z_]\w*)")),
    "markdown": (("namespace", r"^ {0,3}#{1,6}\s+(.*?)\s*#*\s*$"),),
    "toml": (("namespace", r"^\s*\[\[?\s*([^\]]+?)\s*\]\]?\s*(?:#.*)?$"), ("field", r"""^\s*((?:"[^"]*"|'[^']*'|[\w-]+)(?:\s*\.\s*(?:"[^"]*"|'[^']*'|[\w-]+))*)\s*=""")),
    "yaml": (("field", r"""^\s*(?:-\s+)*("[^"]*"|'[^']*'|[^\s#'"\[\]{}&*!|>%@`,:-][^#:]*?)\s*:(?:\s|$)"""),),
    "shell": (("function", r"^\s*function\s+([A-Za-z_][\w:-]*)"), ("function", r"^\s*([A-Za-z_][\w:-]*)\s*\(\s*\)"), ("variable", r"^\s*(?:(?:export|readonly|local|typeset|declare)\s+(?:-\w+\s+)*)?([A-Za-z_]\w*)\+?=")),
}
#: Fixed patterns of languages with several definitions in a line.
ALL = {
    "css": (("class", r"\.(-?[A-Za-z_][\w-]*)"), ("constant", r"#(-?[A-Za-z_][\w-]*)"), ("function", r"@(?:-\w+-)?keyframes\s+([\w-]+)"), ("variable", r"(?:^|[\s{;])(--[\w-]+)\s*:")),
    "html": (("constant", r"""<[A-Za-z][^<>]*?\sid\s*=\s*["']?([^"'\s>]+)"""),),
}
#: Line comments.
COMMENTS = {"ini": r"^\s*[#;]", "dockerfile": r"^\s*#", "toml": r"^\s*#", "yaml": r"^\s*#", "shell": r"^\s*#"}
#: Fixed patterns of SQL: created objects, names after keywords, and what an index or trigger is on; and kinds of objects.
NAME = r'([A-Za-z_"`\[][\w."`\]$]*)'
CREATED = (
    r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+|GLOBAL\s+|LOCAL\s+|MATERIALIZED\s+|EXTERNAL\s+)?"
    r"(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER|UNIQUE\s+INDEX|INDEX|SCHEMA|TYPE|SEQUENCE|DATABASE)\s+(?:IF\s+NOT\s+EXISTS\s+)?"
) + NAME
NAMED = r"(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER|REFERENCES|TRUNCATE|SEQUENCE|SCHEMA|DATABASE|INDEX|CALL)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:ONLY\s+)?(?!SELECT\b|VALUES\b|\()" + NAME
NAMED_ON = r"(?i)\bON\s+(?!\()" + NAME
KINDS = {
    "TABLE": "struct", "VIEW": "interface", "FUNCTION": "function", "PROCEDURE": "function", "TRIGGER": "function", "UNIQUE INDEX": "property", "INDEX": "property", "SCHEMA": "namespace",
    "DATABASE": "namespace", "TYPE": "type", "SEQUENCE": "constant",
}


def _column_of(line: Column, part: Column) -> Column:
    """1-based column of the first place of a part, in UTF-16 units."""
    return (utf16_length(F.substring(line, F.lit(1), F.instr(line, part) - 1)) + 1).cast("int")


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, r"""^(["'])(.*)\1$""", "$2")


def _sql_name(raw: Column) -> Column:
    """Names fold to lower case unless they stand in double quotes; all quotes go."""
    bare = F.regexp_replace(raw, r'["`\[\]]', "")
    return F.when(raw.contains('"'), bare).otherwise(F.lower(bare))


def _code(files: DataFrame) -> DataFrame:
    """Lines of SQL without their comments, and what each creates: ``raw``, ``name`` and where it begins, if anything."""
    lines = lines_of(files.where("lang = 'sql'"), "file").withColumn("code", F.regexp_replace("line_text", "--.*$", ""))
    raw = F.regexp_extract("code", CREATED, 2)
    lines = lines.withColumn("raw", F.when(raw != "", raw)).withColumn("name", _sql_name(F.col("raw")))
    return lines.withColumn("col", _column_of(F.col("code"), F.col("raw")))


def _sql_definitions(files: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    keyword = F.upper(F.regexp_replace(F.regexp_extract("code", CREATED, 1), r"\s+", " "))
    return _code(files).where("name <> ''").select("file", "line", F.try_element_at(kinds, keyword).alias("kind"), "name", "col", F.lit(None).cast("string").alias("container"))


def sql_references(files: DataFrame) -> DataFrame:
    """(file, line, col, end_col, name, text) of the objects that SQL names, without the place where one is created."""
    lines = _code(files)
    at = lambda pattern: F.zip_with(match_spans(F.col("code"), pattern), F.regexp_extract_all("code", F.lit(pattern), F.lit(1)), lambda s, raw: F.struct((s["to"] - utf16_length(raw) + 1).cast("int").alias("col"), (s["to"] + 1).cast("int").alias("end_col"), raw.alias("text")))
    on = F.when(F.col("code").rlike(r"(?i)\b(?:INDEX|TRIGGER)\b"), at(NAMED_ON))
    found = F.when(on.isNull(), at(NAMED)).otherwise(F.concat(at(NAMED), on))
    rows = lines.select("file", "line", F.col("col").alias("def_col"), (F.col("col") + utf16_length("name")).alias("def_end"), F.explode(found).alias("r")).select("file", "line", "def_col", "def_end", "r.*")
    apart = F.col("def_col").isNull() | (F.col("col") >= F.col("def_end")) | (F.col("def_col") >= F.col("end_col"))
    return rows.where(apart).withColumn("name", _sql_name(F.col("text"))).where("name <> ''").select("file", "line", "col", "end_col", "name", "text")


def shell_imports(files: DataFrame) -> DataFrame:
    """(file, line, name, module) of sourced scripts; paths of the machine or with variables lead nowhere in a tree."""
    module = F.regexp_extract("line_text", r"""^\s*(?:source|\.)\s+["']?([^\s"';]+)""", 1)
    rows = lines_of(files.where("lang = 'shell'"), "file").select("file", "line", module.alias("module"))
    return rows.where("module <> '' and not startswith(module, '/') and not contains(module, '$')").select("file", "line", F.regexp_replace(F.substring_index("module", "/", -1), r"\.[^.]+$", "").alias("name"), "module")


def _first_of(files: DataFrame, lang: str) -> DataFrame:
    lines = lines_of(files.where(F.col("lang") == lang), "file")
    if lang == "markdown":
        above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        lines = lines.withColumn("fences", F.count_if(F.col("line_text").rlike("^ {0,3}(```|~~~)")).over(above)).where("fences % 2 = 0").drop("fences")
    if lang in COMMENTS:
        lines = lines.where(~F.col("line_text").rlike(COMMENTS[lang]))
    found = F.coalesce(*[F.when(F.col("line_text").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line_text", p, 1).alias("raw"))) for kind, p in FIRST[lang]])
    rows = lines.withColumn("found", found).where("found is not null").select("file", "line", "found.kind", _bare(F.trim("found.raw")).alias("name"), _column_of(F.col("line_text"), F.trim("found.raw")).alias("col"))
    if lang == "toml":
        above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        table = F.last(F.when(F.col("kind") == "namespace", F.col("name")), ignorenulls=True).over(above)
        return rows.withColumn("container", F.when(F.col("kind") == "field", table)).where("name <> ''")
    return rows.withColumn("container", F.lit(None).cast("string")).where("name <> ''")


def _of_kind(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def _all_of(files: DataFrame, lang: str) -> DataFrame:
    lines = lines_of(files.where(F.col("lang") == lang), "file")
    selectors = F.when(F.col("line_text").rlike(r",\s*$"), F.col("line_text")).otherwise(F.array_join(F.regexp_extract_all("line_text", F.lit(r"([^{};]*)\{"), F.lit(1)), " "))
    where = lambda kind: selectors if lang == "css" and kind in ("class", "constant") else F.col("line_text")
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(where(kind), F.lit(p), F.lit(1)), _of_kind(kind)) for kind, p in ALL[lang]]))
    rows = lines.select("file", "line", "line_text", F.explode(found).alias("f"))
    return rows.select("file", "line", "f.kind", "f.name", _column_of(F.col("line_text"), F.col("f.name")).alias("col"), F.lit(None).cast("string").alias("container"))


def line_definitions(files: DataFrame) -> DataFrame:
    """(file, line, kind, name, col, container) of ``files`` (file, lang, text); ``container`` is the table of a TOML key.

    Fenced code of Markdown defines nothing: a line with an odd number of fences up to it is inside.
    """
    out = _sql_definitions(files)
    for lang in (*FIRST, *ALL):
        out = out.unionByName((_first_of if lang in FIRST else _all_of)(files, lang))
    return out
