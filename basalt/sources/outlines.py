"""Outlines of documents and settings as trees: Markdown headings, YAML and JSON keys, each with what it is under.

Lines and tokens get a level (a heading's, a key's indentation or brackets); the nearest entry before with a smaller level
is the parent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import nested

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(```+|~~~+)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_KEY = re.compile(r"""( *(?:- +)*)("(?:[^"\\]|\\.)*"|'[^']*'|[^\s#:\[\]{},&*!|>%@`-][^:#]*?|[^\s#:\[\]{},&*!|>%@`]\S*?)\s*:(?:\s+(.*)|)$""")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|[{}\[\]:,]|\n', re.S)


def headings(text: str) -> Iterator[tuple[int, int, str]]:
    """(line, level, name) of headings outside fenced code, with number signs or underlined."""
    fence, above = None, ""
    for n, line in enumerate(re.split(r"\r?\n", text), 1):
        mark = _FENCE.match(line)
        if fence:
            fence = None if mark and mark[1].startswith(fence) else fence
            above = ""
            continue
        if mark:
            fence, above = mark[1][:3], ""
            continue
        if (found := _HEADING.match(line)) and found[2]:
            yield n, len(found[1]), found[2].strip()
            above = ""
        elif (under := _UNDERLINE.match(line)) and above.strip():
            yield n - 1, 1 if under[1][0] == "=" else 2, above.strip()
            above = ""
        else:
            above = "" if re.match(r"\s*([-*+>|]|\d+[.)])\s|    ", line) else line


def yaml_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """(line, level, name) of block mappings' keys; the level is the column. Texts of block scalars hold none."""
    scalar = None
    for n, line in enumerate(re.split(r"\r?\n", text), 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip(" "))
        if scalar is not None and indent > scalar:
            continue
        scalar = None
        if line.lstrip().startswith("#"):
            continue
        if found := _KEY.match(line):
            level = len(found[1])
            if re.match(r"[|>][+-]?\d*[+-]?\s*(#.*)?$", found[3] or ""):
                scalar = level
            yield n, level, found[2].strip("\"'") if found[2][0] in "\"'" else found[2]


def json_keys(text: str) -> Iterator[tuple[int, int, str]]:
    """(line, level, name) of keys; the level is the number of open brackets. Comments are allowed."""
    line, depth, last = 1, 0, None
    for found in _TOKEN.finditer(text):
        token = found[0]
        if token == ":" and last is not None:
            yield last[0], depth, last[1][1:-1]
        last = (line, token) if token[0] == '"' else last if token == "\n" or token[0] == "/" else None
        depth += token in "{[" and token != "\n"
        depth -= token in "}]"
        line += token.count("\n")


_READERS = {"markdown": headings, "yaml": yaml_keys, "json": json_keys}


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(file, k, *entry) for file, lang, text in zip(*(c.to_pylist() for c in batch.columns)) for k, entry in enumerate(_READERS[lang](text or ""))]
        files, places, lines, levels, names = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.int32()), pa.array(levels, pa.int64()), pa.array(names, pa.string())], names=["file", "place", "line", "level", "name"])


def outlines(files: DataFrame) -> DataFrame:
    """(file, place, line, name, parent, depth, path) of headings and keys of ``files`` (file, lang, text) in Markdown, YAML and JSON.

    ``place`` numbers a file's entries from 0, ``parent`` is the place of what an entry is under, ``path`` the names down to it.
    """
    read = files.where(F.col("lang").isin(*_READERS)).select("file", "lang", "text").mapInArrow(_levels, "file string, place long, line int, level long, name string")
    return nested(read, ["file"], "place", "level", "name", "line").select("file", "place", "line", F.element_at("path", -1).alias("name"), "parent", "depth", "path")
