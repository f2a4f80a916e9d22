"""Parts of paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last extension with its dot, in lower case; a leading dot begins a name, not an extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def ancestors(path: Column) -> Column:
    """All directory prefixes of a path, the shortest first; none for a path without a slash."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def package_root(specifier: Column) -> Column:
    """Package of an external import: two segments for scoped names, else the first one."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit of all columns."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")
