"""A code map from facts: the file graph, what files and functions are like, who calls and extends whom, symbol trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname
from ..functions.roles import has_entry_name, is_test
from ..sources.shared import written
from .resolve import class_bases, class_scopes, direct_members, extent, inherited, module_names, resolve_imports

def file_edges(imports: DataFrame, references: DataFrame) -> DataFrame:
    """(src, dst, imports, refs): uses of one file by another, by resolved imports and by references to definitions."""
    by_import = imports.where("target_file is not null").select(F.col("file").alias("src"), F.col("target_file").alias("dst"), F.lit(1).alias("i"), F.lit(0).alias("r"))
    by_ref = references.where("outcome = 'def'").select(F.col("file").alias("src"), F.col("target_file").alias("dst"), F.lit(0).alias("i"), F.lit(1).alias("r"))
    return by_import.unionByName(by_ref).where("src <> dst").groupBy("src", "dst").agg(F.sum("i").alias("imports"), F.sum("r").alias("refs"))


def file_facts(facts: DataFrame) -> DataFrame:
    """Per file: definitions, exports (top level, not private), references, functions with longest and mean length, depth, branches."""
    is_def = F.col("fact") == "def"
    named = is_def & F.col("kind").isin("class", "function", "method", "constructor", "constant", "variable", "property")
    top = F.col("scope") == F.concat("file", F.lit("#0"))
    function = is_def & F.col("kind").isin("function", "method", "constructor")
    length = F.when(function, F.col("end_line") - F.col("line") + 1)
    return facts.where("fact <> 'error'").groupBy("file").agg(
        F.count_if(named).alias("defs"), F.count_if(named & top & ~F.col("name").startswith("_")).alias("exports"), F.count_if(F.col("fact") == "ref").alias("refs"),
        F.count_if(function).alias("functions"), F.coalesce(F.max(length), F.lit(0)).cast("long").alias("longest"), F.coalesce(F.round(F.avg(length), 1), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("depth"), F.coalesce(F.sum("branches"), F.lit(0)).cast("long").alias("branches"),
    )


def degrees(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file, in_degree, out_degree, inbound, outbound) of every row of ``files``; both directions in one pass over the edges."""
    weight = F.col("imports") + F.col("refs")
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"), weight.alias("w"))
    sums = ends.groupBy("e.file").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.sum(F.col("e.i") * F.col("w")).alias("inbound"), F.sum(F.col("e.o") * F.col("w")).alias("outbound"))
    return files.select("file").join(sums, "file", "left").select("file", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree", "inbound", "outbound")])


def layers(degree: DataFrame) -> DataFrame:
    """(file, layer): where files stand by who uses whom."""
    i, o = F.col("in_degree"), F.col("out_degree")
    return degree.select("file", F.when((i == 0) & (o == 0), "isolated").when(o == 0, "infra").when(i == 0, "entry").otherwise("domain").alias("layer"))


def dir_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, imports, refs, files) between the folders of files."""
    return edges.groupBy(dirname(F.col("src")).alias("src"), dirname(F.col("dst")).alias("dst")).agg(F.sum("imports").alias("imports"), F.sum("refs").alias("refs"), F.count("*").alias("files")).where("src <> dst")


def subtree_counts(files: DataFrame) -> DataFrame:
    """(dir, files): files below each folder, at any depth; the root is the empty name."""
    return files.select(F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("file")))).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))


def listing(entries: DataFrame, folder: str) -> DataFrame:
    """(name, dir, files) one level below ``folder``, folders first, then by name."""
    inside = entries.where(F.col("file").startswith(f"{folder}/")) if folder else entries
    rest = F.substring(F.col("file"), len(folder) + 2 if folder else 1, 1 << 30)
    rows = inside.select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), (F.instr(rest, "/") > 0).alias("dir"))
    return rows.groupBy("name", "dir").agg(F.count("*").alias("files")).orderBy(F.desc("dir"), F.lower("name"), "name")


def definition_paths(facts: DataFrame, inside_functions: bool = False) -> DataFrame:
    """(file, ord, scope, body, name, kind, line, end_line, depth, path) of named definitions below the module: the symbol tree.

    A name bound again in its scope is one symbol, the last. Definitions in a function's body are left out unless asked for.
    """
    kinds = ("class", "function", "method", "constructor", "constant", "variable")
    defs = facts.where((F.col("fact") == "def") & F.col("kind").isin(*kinds) & F.col("binds"))
    if not inside_functions:
        defs = defs.where(~F.col("local"))
    return defs.select("file", "ord", "scope", "body", "name", "kind", "line", "end_line", (F.size(F.split("path", r"\.")) - 1).alias("depth"), "path")


def reference_counts(facts: DataFrame, references: DataFrame) -> DataFrame:
    """(file, ord, name, kind, uses, files): how often each class, function or method is used, and from how many other files."""
    defs = facts.where("fact = 'def' and kind in ('class', 'function', 'method', 'constructor')").select("file", "ord", "name", "kind")
    return defs.join(_uses(references), ["file", "ord"], "left").select("file", "ord", "name", "kind", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("files", F.lit(0)).alias("files"))


def _uses(references: DataFrame) -> DataFrame:
    told = references.where("outcome = 'def'").select(F.col("file").alias("by"), F.col("target_file").alias("file"), F.col("target_ord").alias("ord"))
    return told.groupBy("file", "ord").agg(F.count("*").alias("uses"), F.count_distinct(F.when(F.col("by") != F.col("file"), F.col("by"))).alias("files"))


def call_edges(facts: DataFrame, references: DataFrame) -> DataFrame:
    """(caller_file, caller_ord, caller, callee_file, callee_ord, callee, calls): calls of resolved functions, methods and classes.

    The caller is the innermost function or class around the call, through lambdas and comprehensions, else the module.
    """
    calls = facts.where("fact = 'call' and name is not null").select("file", F.substring_index("name", ".", -1).alias("called"), (F.col("ord") - 1).alias("ref_ord"))
    told = references.where("outcome = 'def'").select("file", F.col("ord").alias("ref_ord"), F.col("name").alias("called"), F.col("holder").alias("caller_ord"), "target_file", "target_ord")
    named = facts.where("fact = 'def' and kind in ('class', 'function', 'method', 'constructor')").select("file", "ord", "name")
    targets = named.select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), F.col("name").alias("callee"))
    callers = named.select("file", F.col("ord").alias("caller_ord"), F.col("name").alias("caller"))
    met = calls.join(told, ["file", "ref_ord", "called"]).join(targets, ["target_file", "target_ord"]).join(callers, ["file", "caller_ord"], "left")
    keys = [F.col("file").alias("caller_file"), "caller_ord", F.coalesce("caller", F.lit("<module>")).alias("caller"), F.col("target_file").alias("callee_file"), F.col("target_ord").alias("callee_ord"), "callee"]
    return met.groupBy(*keys).agg(F.count("*").alias("calls"))


def coverage(references: DataFrame) -> DataFrame:
    """(kind, outcome, n): how many references of each kind are resolved, external or unresolved."""
    return references.groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def _hierarchy(facts: DataFrame, imports: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(derived, base, dist) of classes by number, and the numbers (owner, number) of their scopes: of the many pairs only these go about."""
    modules = written(module_names(facts.where("fact = 'scope' and parent is null").select("file")))
    imports = resolve_imports(facts, modules) if imports is None else imports
    bases = class_bases(facts, imports, direct_members(facts, imports, modules), extent(facts))
    numbers = bases.select(F.explode(F.array("derived", "base")).alias("owner")).distinct()
    numbers = written(numbers.withColumn("number", F.monotonically_increasing_id()), "numbers")
    for side in ("derived", "base"):
        bases = bases.join(numbers.withColumnRenamed("owner", side), side).drop(side).withColumnRenamed("number", side)
    return inherited(bases), numbers


def ancestors_of_types(facts: DataFrame, imports: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(derived, base, dist): every class with all that it extends, as file:dotted name, at the shortest distance; cycles end.

    ``depth`` is how far up to go.
    """
    above, numbers = _hierarchy(facts, imports)
    above = above if depth is None else above.where(F.col("dist") <= depth)
    names = facts.where("fact = 'def' and kind = 'class'").select(F.col("body").alias("owner"), F.concat_ws(":", "file", "path").alias("_name"))
    names = written(names.join(numbers, "owner").select("number", "_name"), "names")
    for side in ("derived", "base"):
        above = above.join(names, F.col(side) == F.col("number")).withColumn(side, F.col("_name")).drop("number", "_name")
    return above.select("derived", "base", "dist")


def implementations(facts: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(base, method, derived): methods of a class that a class below it defines anew; classes as file:dotted name."""
    names = class_scopes(facts).join(facts.where("fact = 'def' and kind = 'class'").select("file", "ord", F.concat_ws(":", "file", "path").alias("of")), ["file", "ord"]).select("owner", "of")
    above, numbers = _hierarchy(facts, imports)
    methods = facts.where("fact = 'def' and kind = 'method' and binds").select("owner", F.col("name").alias("method")).join(names, "owner").join(numbers, "owner")
    methods = written(methods.select("number", "method", "of"), "methods")
    side = lambda c: methods.select(F.col("number").alias(c), "method", F.col("of").alias(f"{c}_name"))
    return above.join(side("base"), "base").join(side("derived"), ["derived", "method"]).select(F.col("base_name").alias("base"), "method", F.col("derived_name").alias("derived"))


def argument_flow(facts: DataFrame, references: DataFrame) -> DataFrame:
    """(caller_file, callee_file, callee, name, calls): arguments that hold a name which is also a parameter's of what is called.

    By name alone: at any position, by keyword, or inside an expression; of a class called, its constructor's parameters.
    The implicit first parameter of a method takes no argument.
    """
    names = facts.where("fact = 'argument'").select("file", (F.col("of") - 1).alias("ref_ord"), F.explode("parts").alias("name")).distinct()
    told = references.where("outcome = 'def'").select("file", F.col("ord").alias("ref_ord"), "target_file", "target_ord")
    params = facts.where("fact = 'def' and kind = 'parameter' and of is not null and not (place is null and name in ('self', 'cls'))").select(F.col("file").alias("target_file"), F.col("of").alias("function"), "name")
    functions = facts.where("fact = 'def' and kind in ('function', 'method', 'constructor')").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), F.col("ord").alias("function"), F.col("name").alias("callee"))
    makers = facts.where("fact = 'def' and kind = 'constructor' and binds").select(F.col("file").alias("target_file"), F.col("ord").alias("function"), "owner")
    classes = class_scopes(facts).select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), "owner").join(facts.where("fact = 'def' and kind = 'class'").select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), F.col("name").alias("callee")), ["target_file", "target_ord"])
    called = functions.unionByName(classes.join(makers, ["target_file", "owner"]).select("target_file", "target_ord", "function", "callee"))
    met = names.join(told, ["file", "ref_ord"]).join(called.join(params, ["target_file", "function"]), ["target_file", "target_ord", "name"])
    return met.groupBy(F.col("file").alias("caller_file"), F.col("target_file").alias("callee_file"), "callee", "name").agg(F.count("*").alias("calls"))


def outside_imports(imports: DataFrame) -> DataFrame:
    """(file, package): what each file imports from outside the tree, a row an import."""
    return imports.where("outcome = 'external'").select("file", F.split_part("module", F.lit("."), F.lit(1)).alias("package"))


def external_packages(imports: DataFrame) -> DataFrame:
    """(package, imports, files) of what is imported from outside the tree."""
    return outside_imports(imports).groupBy("package").agg(F.count("*").alias("imports"), F.count_distinct("file").alias("files"))


def start_here(degree: DataFrame, facts: DataFrame, limit: int = 12, denoise: bool = True) -> DataFrame:
    """(file, kind, score, inbound, reasons): the first files to read, those that look like entries before those used most.

    ``score`` is the number of files that use a file, and 1000 more for an entry, by its name or its main block. The list
    has ``limit`` rows, at least 12. ``denoise`` leaves out tests.
    """
    blocks = facts.where("fact = 'scope' and parent is null").select("file", F.col("text").isNotNull().alias("main"))
    told = degree.join(blocks, "file", "left")
    reasons = F.array_compact(F.array(F.when(has_entry_name(F.col("file")), F.lit("name")), F.when(F.col("main"), F.lit("main block"))))
    told = told.select("file", F.col("in_degree").alias("inbound"), reasons.alias("reasons"))
    told = told.where(~is_test(F.col("file"))) if denoise else told
    entry = F.size("reasons") > 0
    told = told.select("file", F.when(entry, "entry").otherwise("hot").alias("kind"), (F.col("inbound") + F.when(entry, 1000).otherwise(0)).alias("score"), "inbound", "reasons")
    return told.orderBy(F.desc("score"), "file").limit(max(limit, 12))
