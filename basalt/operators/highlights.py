"""Spans of names to colour, of all files at once: what a name is, one span at a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import Greedy, folded
from .positions import named_ranges

#: Kinds of spans, and names that keep their colour.
EMPHASIS, DIM, LOCAL = 0, 1, 2
SELF_NAMES = ("self", "cls", "this", "super")


def spans(facts: DataFrame, references: DataFrame) -> DataFrame:
    """(file, line, col, length, kind) of names within a line that don't overlap, the first at a place being kept.

    ``kind`` is 0 for what leads to a definition or module of the tree, 1 for what comes from outside, 2 for parameters
    and names that lead nowhere; a member that isn't resolved has no span.
    """
    defs = facts.where("fact = 'def'").select("file", "ord", F.when(F.col("kind") == "parameter", LOCAL).otherwise(EMPHASIS).alias("of"))
    told = references.join(defs.select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), "of"), ["target_file", "target_ord"], "left")
    o = F.col("outcome")
    kind = F.when(o == "external", DIM).when(o == "module", EMPHASIS).when(o == "def", F.col("of")).when(F.col("kind") == "identifier", LOCAL)
    of_ref = told.where(~F.col("name").isin(*SELF_NAMES)).select("file", F.lit("ref").alias("fact"), "ord", kind.alias("of"))
    found = named_ranges(facts).where("fact <> 'import' and line = end_line and end_col > col").join(defs.withColumn("fact", F.lit("def")).unionByName(of_ref), ["file", "fact", "ord"]).where("of is not null")
    rows = found.select("file", "line", "col", "end_col", F.col("col").alias("at"), (F.col("end_col") - F.col("col")).alias("length"), F.col("of").alias("kind"), "ord")
    return folded(rows, ["file", "line"], ["col", "ord"], Greedy, "col int, length int, kind int, ord int").drop("ord")
