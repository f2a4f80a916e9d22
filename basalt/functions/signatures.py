"""Declared types in the first line of a definition, in three styles: ``name: type``, ``name type`` and ``type name``.

Brackets are matched by depth, a running sum over the characters outside quotes; parameters are what lies between commas
of the outermost depth.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words before a type that belong to no type.
MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "sealed", "non-sealed")

_QUOTED = re.compile(r"""(["'`])(?:\\.|(?!\1).)*(?:\1|$)""")
_STEP = dict.fromkeys("([{<", 1) | dict.fromkeys(")]}>", -1)
_NOTE = re.compile(r"@[\w.]+(\([^)]*\))?")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def _plain(text: str) -> str:
    """``text`` with quotes, arrows and comparisons blanked out, of the same length."""
    return re.sub(r"->|=>|[<>=!]=", "  ", _QUOTED.sub(lambda m: "_" * len(m[0]), text))


def _depths(plain: str) -> list[int]:
    return list(accumulate(_STEP.get(c, 0) for c in plain))


def parameter_list(line: str, start: int = 0) -> tuple[int, int] | None:
    """Where the first round brackets from ``start`` on open and close; none where they don't close."""
    plain = _plain(line)
    opened = plain.find("(", start)
    if opened < 0:
        return None
    round_ = accumulate({"(": 1, ")": -1}.get(c, 0) for c in plain[opened:])
    return next(((opened, opened + i) for i, d in enumerate(round_) if d == 0), None)


def split_outside(text: str, at: str = ",") -> list[str]:
    """Parts of ``text`` between the marks that are in no bracket and no quotes."""
    plain = _plain(text)
    cuts = [i for i, (c, d) in enumerate(zip(plain, _depths(plain))) if c == at and d <= 0]
    return [text[a:b] for a, b in zip([0, *(i + 1 for i in cuts)], [*cuts, len(text)])]


def _colon(part: str) -> tuple[str, str] | None:
    name, mark, kind = split_outside(part, "=")[0].strip().lstrip(".*").strip().partition(":")
    found = name.strip().rstrip("?")
    return (found, kind.strip()) if mark and kind.strip() and _NAME.fullmatch(found) and not name.strip().endswith("?") else None


def _spaced(part: str, name_first: bool) -> tuple[str, str] | None:
    words = re.sub(r"\s+", " ", re.sub(r"\bfinal\b", " ", _NOTE.sub(" ", split_outside(part, "=")[0]))).strip()
    if " " not in words:
        return None
    if name_first:
        name, kind = words.split(" ", 1)
    else:
        kind, name = words.rsplit(" ", 1)
    return name, kind


def signature(line: str, style: str) -> tuple[list[tuple[str, str]], str | None]:
    """(parameters with a type as (name, type), result) of a definition's first line; ``style`` is colon, go or java.

    Parameters without a type are left out, defaults too. A line whose brackets don't close has neither.
    """
    line = (line or "").split("\n")[0].strip()
    receiver = parameter_list(line) if style == "go" and re.match(r"func\s*\(", line) else None
    place = parameter_list(line, receiver[1] + 1 if receiver else 0)
    if not place:
        return [], None
    inside, rest = line[place[0] + 1 : place[1]], line[place[1] + 1 :].strip()
    take = {"colon": _colon, "go": lambda p: _spaced(p, True), "java": lambda p: _spaced(p, False)}[style]
    params = [p for part in split_outside(inside) if (p := take(part))]
    result = ""
    if style == "java":
        words = " ".join(w for w in _NOTE.sub(" ", line[: place[0]]).split() if w not in MODIFIERS)
        found = re.search(r"([\w$.]+(?:<.*>)?(?:\[\])*)\s+([\w$]+)$", words)
        result = found[1] if found and found[1] != found[2] else ""
    elif style == "go":
        result = re.sub(r"[:{]\s*$", "", rest)
    elif rest.startswith("->"):
        result = split_outside(rest[2:], ":")[0]
    elif rest.startswith(":"):
        result = re.split(r"=>|\{", rest[1:])[0]
    elif rest.startswith("=>"):
        result = rest[2:].split("{")[0]
    return params, result.strip() or None


def signature_parts(line: Column, style: str) -> Column:
    """``signature`` of a column: a struct of ``params`` (name, type) and ``result``."""

    @F.pandas_udf("params array<struct<name string, type string>>, result string")
    def parts(lines: pd.Series) -> pd.DataFrame:
        found = [signature(x, style) for x in lines]
        return pd.DataFrame({"params": [[{"name": n, "type": t} for n, t in p] for p, _ in found], "result": [r for _, r in found]})

    return parts(line)
