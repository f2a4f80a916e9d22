"""Text search: lines, matches with positions, grouping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import utf16_length

LINE_CUT = 400


def lines_of(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, line, line_text) of all lines, from 1; both kinds of line end separate them."""
    return files.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line_text")).select(key, (F.col("pos") + 1).alias("line"), "line_text")


def pattern_of(query: str, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False) -> str:
    """Java pattern of a query. Words are ASCII, so their borders are spelled out; case folds in all scripts."""
    body = query if regex else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", query)
    if whole_word:
        body = rf"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))(?:{body})(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return body if case_sensitive else f"(?iu){body}"


def glob_of(glob: str) -> str:
    """Java pattern of a search glob: unanchored at its start, any case, a question mark takes any character."""
    body = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "." if p == "?" else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", glob))
    return f"(?iu)(^|/){body}$"


def match_spans(line: Column, pattern: str) -> Column:
    """Array of (from, to) of all matches in a line, 0-based in UTF-16 units, the end exclusive; empty ones too.

    The texts between the matches and those of the matches, in turn, make up the line. An empty match at the start leaves
    no text before it.
    """
    hits = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    between = F.split(line, pattern, -1)
    between = F.when(F.size(between) == F.size(hits), F.concat(F.array(F.lit("")), between)).otherwise(between)
    lengths = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda g, h: F.struct(utf16_length(g).alias("gap"), utf16_length(h).alias("hit")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("out"))
    step = lambda acc, m: F.struct((acc["at"] + m["gap"] + m["hit"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + m["gap"]).alias("from"), (acc["at"] + m["gap"] + m["hit"]).alias("to"))).alias("out"))
    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def chosen_files(files: DataFrame, key: str = "file", glob: str | None = None, under: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the files to search: those that match a glob, lie under a directory, and are listed, as far as these are given."""
    if glob:
        files = files.where(F.col(key).rlike(glob_of(glob)))
    if under:
        files = files.where(F.col(key).startswith(under.rstrip("/") + "/") | (F.col(key) == under.rstrip("/")))
    return files if only is None else files.where(F.col(key).isin(list(only)))


def _compiled(files: DataFrame, pattern: str) -> None:
    try:
        files.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as error:
        raise ValueError(f"not a regular expression: {pattern}") from error


def search(files: DataFrame, query: str, key: str = "file", text: str = "text", regex: bool = False, whole_word: bool = False, case_sensitive: bool = False, max_results: int | None = 500, glob: str | None = None, under: str | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """(key, line, col, end_col, line_text) of matches; with ``max_results``, in order, with ``match`` and ``truncated``.

    Each line is searched by itself. For a query in plain characters, files that don't hold it go before they are cut into
    lines; a regular expression is tried on lines only. ``max_results`` (1 to 5000) is part of the feature: the first so many hits by key, line and column, numbered
    from 1, and whether there are more. Line texts are cut to 400 characters; positions refer to the uncut line. A pattern
    that doesn't compile raises ValueError.
    """
    pattern = pattern_of(query, regex, whole_word, case_sensitive)
    _compiled(files, pattern)
    files = chosen_files(files, key, glob, under, only)
    if not regex and case_sensitive:
        files = files.where(F.contains(F.col(text), F.lit(query)))
    elif not regex and query.isascii():
        # folded twice, as some letters beyond ASCII fold to one of it
        files = files.where(F.contains(F.upper(F.lower(text)), F.lit(query.upper())))
    hits = lines_of(files, key, text).where(F.col("line_text").rlike(pattern))
    hits = hits.select(key, "line", F.explode(match_spans(F.col("line_text"), pattern)).alias("m"), "line_text")
    out = hits.select(key, "line", (F.col("m.from") + 1).alias("col"), (F.col("m.to") + 1).alias("end_col"), F.left("line_text", F.lit(LINE_CUT)).alias("line_text"))
    if max_results is None:
        return out
    most = max(1, min(max_results, 5000))
    first = out.orderBy(key, "line", "col").limit(most + 1)
    numbered = first.withColumn("match", F.row_number().over(Window.orderBy(key, "line", "col")))
    return numbered.withColumn("truncated", F.max("match").over(Window.partitionBy()) > most).where(F.col("match") <= most)


def by_file(matches: DataFrame, key: str = "file") -> DataFrame:
    """Hits of each file: their number, first line, and lines in order."""
    return matches.groupBy(key).agg(F.count("*").alias("hits"), F.min("line").alias("first_line"), F.array_join(F.array_sort(F.collect_set("line")), ",").alias("hit_lines"))
