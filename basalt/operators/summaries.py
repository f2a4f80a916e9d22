"""What can be said of a file or of a name that leads nowhere: summaries of files, and why references stay unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import is_test
from .resolve import module_scope


def unresolved_reasons(facts: DataFrame, references: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, ord, line, name, reason) of unresolved references.

    ``reason`` is dynamic-member (subscripted, or a member of a call's or subscript's value), module-not-found (what binds
    the name imports a relative module that the tree lacks), not-in-project (another module that it lacks), or else
    needs-type-info. Names that only stars may bring are judged by the first star.
    """
    lost = references.where("outcome = 'unresolved'").select("file", "ord", "line", "name")
    told = facts.where("fact = 'ref'").select("file", "ord", "parts", "text", "found", F.coalesce("found_ord", F.get("stars", F.lit(0))).alias("binding"))
    brought = imports.select("file", F.col("ord").alias("binding"), "outcome", "kind", "target_file").join(facts.where("fact = 'import'").select("file", F.col("ord").alias("binding"), F.col("module").alias("written")), ["file", "binding"])
    met = lost.join(told, ["file", "ord"]).join(brought, ["file", "binding"], "left")
    outside = F.col("found").isin("import", "star") & F.col("target_file").isNull() & ((F.col("outcome") == "external") | (F.col("kind") != "named"))
    reason = F.when((F.col("text") == "[") | F.col("parts").isNull(), "dynamic-member").when(outside, F.when(F.col("written").startswith("."), "module-not-found").otherwise("not-in-project")).otherwise("needs-type-info")
    return met.select("file", "ord", "line", "name", reason.alias("reason"))


def file_summaries(facts: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a file: what it defines at the top, imports, and who uses it how often.

    (file, exports, kinds, project_imports, external_imports, inbound, inbound_tests, users, outbound, longest): ``kinds``
    has the numbers of exports by kind, most first; ``inbound`` counts imports and references from other files.
    """
    files = facts.where("fact = 'scope' and parent is null").select("file")
    top = facts.where((F.col("fact") == "def") & (F.col("scope") == module_scope()) & F.col("binds") & (F.col("kind") != "property"))
    counted = top.groupBy("file", "kind").count().groupBy("file").agg(F.sum("count").alias("exports"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("by"), "kind"))).alias("k"))
    counted = counted.select("file", "exports", F.array_join(F.transform("k", lambda k: F.concat((-k["by"]).cast("string"), F.lit(" "), k["kind"])), ", ").alias("kinds"))
    brought = imports.groupBy("file").agg(F.count_if(F.col("target_file").isNotNull()).alias("project_imports"), F.count_if(F.col("target_file").isNull()).alias("external_imports"))
    uses = F.col("imports") + F.col("refs")
    inbound = edges.groupBy(F.col("dst").alias("file")).agg(F.sum(uses).alias("inbound"), F.sum(F.when(is_test(F.col("src")), uses).otherwise(0)).alias("inbound_tests"), F.count("*").alias("users"))
    outbound = edges.groupBy(F.col("src").alias("file")).agg(F.count("*").alias("outbound"))
    longest = facts.where("fact = 'def' and kind in ('function', 'method', 'constructor')").groupBy("file").agg(F.max(F.col("end_line") - F.col("line") + 1).cast("long").alias("longest"))
    out = files
    for part in (counted, brought, inbound, outbound, longest):
        out = out.join(part, "file", "left")
    numbers = ("exports", "project_imports", "external_imports", "inbound", "inbound_tests", "users", "outbound", "longest")
    return out.select("file", F.coalesce("kinds", F.lit("")).alias("kinds"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers])
