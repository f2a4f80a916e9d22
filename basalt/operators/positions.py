"""Lookups by position: which definition, reference or literal is at a place, and which definition is around it.

Ranges and points meet by a stabbing join on bins of lines. A range lies in the bins of the one width, of a few that grow
by a fixed factor, at which it touches two at most; a point asks at its bin of each width that ranges have. So a range costs
two rows and a point one for each of these widths, however long ranges are, and only ranges near a point's size meet it.
Tables with rows for names or places are never broadcast: by the size of their compressed files they look far smaller than
they are in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the narrowest bin, how much wider the next is, and how many widths there are.
WIDTH, FACTOR, LEVELS = 8, 16, 6


def before(a: tuple[str, str], b: tuple[str, str], or_same: bool = True) -> Column:
    """Whether the place in columns ``a`` (line, column) is before that in ``b``, or the same."""
    (la, ca), (lb, cb) = (tuple(map(F.col, x)) for x in (a, b))
    return (la < lb) | ((la == lb) & ((ca <= cb) if or_same else (ca < cb)))


def _each(rows: DataFrame) -> DataFrame:
    """``rows``, to be joined by sorting both sides."""
    return rows.hint("merge")


def _level(first: str, last: str, narrowest: int) -> Column:
    length = F.col(last) - F.col(first)
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(length < narrowest * FACTOR**k, k).otherwise(level)
    return level.cast("int")


def widths(ranges: DataFrame, first: str, last: str, narrowest: int = WIDTH) -> list[int]:
    """Which of the ``LEVELS`` widths of bins hold ranges."""
    return sorted(r["k"] for r in ranges.select(_level(first, last, narrowest).alias("k")).distinct().collect())


def stabbed(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, first: str, last: str, narrowest: int = WIDTH) -> DataFrame:
    """Columns of ``points`` and ``ranges`` where the keys are equal and ``first`` <= ``at`` <= ``last``, all of them whole numbers.

    Columns of the two must not share names, but for ``keys``. ``narrowest`` is the width of the smallest bins.
    """
    width = lambda level: narrowest * FACTOR**level
    size = F.lit(narrowest) * F.pow(F.lit(FACTOR), F.col("_level")).cast("long")
    held = ranges.withColumn("_level", _level(first, last, narrowest)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / size), F.floor(F.col(last) / size))))
    asked = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(at) / width(k)).alias("bin")) for k in widths(ranges, first, last, narrowest) or [0]])
    asks = points.withColumn("_ask", F.explode(asked)).withColumn("_level", F.col("_ask.level")).withColumn("_bin", F.col("_ask.bin")).drop("_ask")
    met = asks.join(_each(held), [*keys, "_level", "_bin"])
    return met.where((F.col(first) <= F.col(at)) & (F.col(at) <= F.col(last))).drop("_level", "_bin")


def _placed(points: DataFrame) -> DataFrame:
    return points.select("file", F.col("line").alias("at_line"), F.col("col").alias("at_col")).distinct()


def at_places(points: DataFrame, ranges: DataFrame, keep: list[str]) -> DataFrame:
    """(file, at_line, at_col, keep...) of the ranges (file, line, col, end_line, end_col, keep...) that hold a point, both ends included."""
    met = stabbed(_placed(points), ranges.select("file", "line", "col", "end_line", "end_col", *keep), ["file"], "at_line", "line", "end_line")
    inside = before(("line", "col"), ("at_line", "at_col")) & before(("at_line", "at_col"), ("end_line", "end_col"))
    return met.where(inside)


def named_ranges(facts: DataFrame) -> DataFrame:
    """(file, fact, ord, name, line, col, end_line, end_col): where the names of definitions, references and imports stand."""
    end = F.col("name_col") + F.octet_length(F.encode("name", "UTF-16LE")).cast("int") / 2
    defs = facts.where("fact = 'def' and name_line is not null").select("file", "fact", "ord", "name", F.col("name_line").alias("line"), F.col("name_col").alias("col"), F.col("name_line").alias("end_line"), end.cast("int").alias("end_col"))
    return defs.unionByName(facts.where("fact in ('ref', 'import')").select("file", "fact", "ord", "name", "line", "col", "end_line", "end_col"))


def around(points: DataFrame, facts: DataFrame, kinds: tuple[str, ...] = ("class", "function", "method", "constructor")) -> DataFrame:
    """(file, at_line, at_col, ord, name, kind) of the innermost definition around each place: the one that starts last."""
    defs = facts.where((F.col("fact") == "def") & F.col("kind").isin(*kinds))
    met = at_places(points, defs, ["ord", "name", "kind"])
    return met.groupBy("file", "at_line", "at_col").agg(F.max_by(F.struct("ord", "name", "kind"), F.struct("line", "col", "ord")).alias("b")).select("file", "at_line", "at_col", "b.*")


def literals_at(points: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, at_line, at_col, ord, kind, text) of the smallest literal that holds each place."""
    met = at_places(points, facts.where("fact = 'literal'"), ["ord", "kind", "text"])
    return met.groupBy("file", "at_line", "at_col").agg(F.min_by(F.struct("ord", "kind", "text"), F.struct(F.col("end_line") - F.col("line"), F.col("end_col") - F.col("col"), "ord")).alias("b")).select("file", "at_line", "at_col", "b.*")


def definitions_at(points: DataFrame, facts: DataFrame, references: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, at_line, at_col, symbol, reason, target_file, target_ord, target_line, target_col): goto-definition of every place.

    ``reason`` is resolved, external, unresolved or no-symbol. A definition leads to itself; a module to its file's start.
    Of the names that hold a place a definition comes before a reference, and that before an import; of several the one with
    the shortest range, then the first. The names that stand on asked lines are followed, each once, and meet the places last,
    a line's names and places together: places, of which there are the most, are never shuffled one by one.
    """
    lines = points.groupBy("file", F.col("line").alias("at_line")).agg(F.collect_set("col").alias("_cols"))
    spans = named_ranges(facts).withColumn("at_line", F.explode(F.sequence("line", "end_line")))
    met = spans.join(_each(lines), ["file", "at_line"]).where(F.exists("_cols", lambda c: _holds(c, F.col))).drop("_cols")
    by_ref = references.select("file", F.lit("ref").alias("fact"), "ord", "outcome", "target_file", "target_ord")
    by_import = imports.select("file", F.lit("import").alias("fact"), "ord", "outcome", "target_file", "target_ord")
    told = met.join(_each(by_ref.unionByName(by_import)), ["file", "fact", "ord"], "left")
    is_def = F.col("fact") == "def"
    rank = F.when(is_def, 0).when(F.col("fact") == "ref", 1).otherwise(2)
    place = (rank.alias("rank"), (F.col("end_line") - F.col("line")).alias("lines"), (F.col("end_col") - F.col("col")).alias("cols"))
    told = told.select("file", "at_line", "line", "col", "end_line", "end_col", *place, "ord", "name", F.when(is_def, "def").otherwise(F.col("outcome")).alias("outcome"), F.when(is_def, F.col("file")).otherwise(F.col("target_file")).alias("target_file"), F.when(is_def, F.col("ord")).otherwise(F.col("target_ord")).alias("target_ord"))
    names = facts.where("fact = 'def'").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), F.col("name_line").alias("d_line"), F.col("name_col").alias("d_col"))
    told = told.join(_each(names), ["target_file", "target_ord"], "left")
    each = F.struct("rank", "lines", "cols", "ord", "name", "outcome", "target_file", "target_ord", "d_line", "d_col", "line", "col", "end_line", "end_col")
    told = told.groupBy("file", "at_line").agg(F.collect_list(each).alias("_names"))
    out = lines.join(_each(told), ["file", "at_line"], "left").select("file", "at_line", F.explode("_cols").alias("at_col"), "_names")
    out = out.select("file", "at_line", "at_col", F.array_min(F.filter("_names", lambda n: _holds(F.col("at_col"), lambda c: F.col(c) if c == "at_line" else n[c]))).alias("b"))
    out = out.select("file", "at_line", "at_col", "b.name", "b.outcome", "b.target_file", "b.target_ord", "b.d_line", "b.d_col")
    reason = F.when(F.col("outcome").isin("def", "module"), "resolved").when(F.col("outcome") == "external", "external").when(F.col("name").isNotNull(), "unresolved").otherwise("no-symbol")
    start = F.when(F.col("outcome") == "module", 1)
    return out.select("file", "at_line", "at_col", F.col("name").alias("symbol"), reason.alias("reason"), "target_file", "target_ord", F.coalesce("d_line", start).alias("target_line"), F.coalesce("d_col", start).alias("target_col"))


def _holds(col: Column, of) -> Column:
    """Whether a range holds column ``col`` of line ``at_line``, both ends included; ``of`` gives the range's places by name."""
    after = (of("line") < of("at_line")) | ((of("line") == of("at_line")) & (of("col") <= col))
    return after & ((of("at_line") < of("end_line")) | ((of("at_line") == of("end_line")) & (col <= of("end_col"))))


def hovers_at(points: DataFrame, facts: DataFrame, references: DataFrame, imports: DataFrame) -> DataFrame:
    """``definitions_at`` with kind, dotted name, type, first line of documentation and number of uses of what is meant."""
    names = facts.where("fact = 'def'").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), "kind", "path", F.col("type_name").alias("type"), "doc")
    uses = references.where("outcome = 'def'").groupBy("target_file", "target_ord").agg(F.count("*").alias("uses"))
    return definitions_at(points, facts, references, imports).join(_each(names), ["target_file", "target_ord"], "left").join(_each(uses), ["target_file", "target_ord"], "left").withColumn("uses", F.coalesce("uses", F.when(F.col("kind").isNotNull(), 0)))


def references_to(facts: DataFrame, references: DataFrame, imports: DataFrame) -> DataFrame:
    """(target_file, target_ord, file, line, col, kind): every place that means a definition, references and import sites, each once."""
    at_import = facts.where("fact = 'import'").select("file", "ord", "line", "col")
    sites = imports.where("outcome = 'def'").join(_each(at_import), ["file", "ord"]).select("target_file", "target_ord", "file", "line", "col", F.lit("import").alias("kind"))
    refs = references.where("outcome = 'def'").select("target_file", "target_ord", "file", "line", "col", F.lit("ref").alias("kind"))
    return refs.unionByName(sites).groupBy("target_file", "target_ord", "file", "line", "col").agg(F.max("kind").alias("kind"))
