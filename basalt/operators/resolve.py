"""Names to definitions across the files of a tree: imports, classes and what they inherit, types, member chains.

What a name means within its file is told by the facts themselves. Here everything is equi-joins on small keys: a scope
that holds names (``file#n``: a module's or a class's), or a row of a file (file, ord). Loops go by doubling (re-exports,
inheritance), by the length of member chains, or by the rounds in which types spread; each round is written out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.python_facts import BUILTINS
from ..sources.shared import written


class Resolved:
    """``imports``, ``bases`` (derived, base: scopes of classes), ``types`` (file, ord, owner), ``members`` and ``references``.

    What classes extend and hold, and which values are of them, is worked out when it is first asked for: chains that lead
    only through modules, or that their files tell, don't ask.
    """

    def __init__(self, facts: DataFrame, across: bool):
        self._facts, self.size = facts, extent(facts)
        self._modules = written(module_names(facts.where("fact = 'scope' and parent is null").select("file")), "modules")
        self.imports, self._starred = _imports(facts, self._modules, self.size.stars)
        self._direct = direct_members(facts, self.imports, self._modules, self._starred)
        self.across = across

    @cached_property
    def bases(self) -> DataFrame:
        return class_bases(self._facts, self.imports, self._direct, self.size)

    @cached_property
    def members(self) -> DataFrame:
        return members(self._facts, self._direct, self.bases)

    @cached_property
    def types(self) -> DataFrame:
        return value_types(self._facts, self.imports, self.members, self.size)

    @cached_property
    def references(self) -> DataFrame:
        every = self._facts.where("fact = 'ref'").withColumn("at", F.col("file"))
        keys = ["at", "ord"] if self.across else ["at", "ord", "line", "col", "name", "kind", "scope", "holder"]
        every = every.select(*keys, "file", "parts", "found", "found_ord", "stars", told_in_file(self._facts, "settled"))
        in_modules = _nearest(*_alone(self._direct.where(F.col("owner").endswith("#0"))))
        out = walk(every.where("found is not null"), keys, self.imports, in_modules, lambda: (self.types, self.members), self.size.refs, self.size.stars)
        if not self.across:
            out = out.unionByName(every.where("found is null").select(*keys, F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("target_file"), F.lit(None).cast("int").alias("target_ord")))
        return out.select(F.col("at").alias("file"), *keys[1:], F.coalesce("outcome", F.lit("unresolved")).alias("outcome"), F.when(F.col("outcome").isNotNull(), F.col("target_file")).alias("target_file"), F.when(F.col("outcome").isNotNull(), F.col("target_ord")).alias("target_ord"))


def module_scope(file: str = "file") -> Column:
    return F.concat(F.col(file), F.lit("#0"))


def resolve_names(facts: DataFrame) -> DataFrame:
    """(file, ref_ord, name, found, target, module) of identifier references: what binds the name in its own file.

    ``found`` is def, import, star, builtin or null; ``module`` the one that an import or the first star names.
    """
    refs = facts.where("fact = 'ref' and kind = 'identifier'").select("file", F.col("ord").alias("ref_ord"), "name", "found", F.coalesce("found_ord", F.get("stars", F.lit(0))).alias("target"))
    modules = facts.where("fact = 'import'").select("file", F.col("ord").alias("target"), "module")
    return refs.join(modules, ["file", "target"], "left").select("file", "ref_ord", "name", "found", "target", "module")


def told_in_file(facts: DataFrame, column: str) -> Column:
    """A column of what the parser has settled within the file; null where the facts don't have it, so that joins tell."""
    return (F.col(column) if column in facts.columns else F.lit(None).cast("boolean" if column in ("alone", "inner") else "string" if column == "body" else "int")).alias(column)


def _settled(facts: DataFrame) -> tuple[Column, Column]:
    return told_in_file(facts, "settled"), told_in_file(facts, "settled_body")


def _owner_settled(file: str = "file") -> Column:
    """Scope of the class to which a chain leads within its file."""
    return F.when(F.col("settled_body").isNotNull(), F.concat(F.col(file), F.lit("#"), F.col("settled_body").cast("string")))


def module_names(files: DataFrame) -> DataFrame:
    """(module, file): the dotted names under which the files of a tree (``file``) can be imported; ``src`` may be left out."""
    path = F.regexp_replace(F.regexp_replace("file", r"\.pyi?$", ""), r"(^|/)__init__$", "")
    names = F.array_distinct(F.array(path, F.regexp_replace(path, r"^(?:src|lib)/", "")))
    named = files.where(F.col("file").rlike(r"\.pyi?$")).select("file", F.explode(names).alias("path")).where("path <> ''")
    return named.groupBy(F.replace("path", F.lit("/"), F.lit(".")).alias("module")).agg(F.min_by("file", F.struct(F.length("file"), "file")).alias("file"))


def absolute(file: Column, module: Column) -> Column:
    """Dotted name of an import; leading dots go up from the file's package."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    steps = F.split(file, "/")
    package = F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - dots, F.lit(0))), ".")
    rest = F.regexp_replace(module, r"^\.+", "")
    return F.when(dots == 0, module).otherwise(F.concat_ws(".", F.when(package != "", package), F.when(rest != "", rest)))


def resolve_imports(facts: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(file, ord, name, kind, scope, module, outcome, target_file, target_ord) of every import.

    ``outcome`` is def (of the module, at once or through re-exports), module (a file of the tree), external, or missing
    (a module of the tree without that name). A named import prefers a definition to a submodule of that name. Re-exports
    are pointers from import to import, followed by doubling; a round in which none ends leaves only cycles, which are missing.
    """
    if modules is None:
        modules = written(module_names(facts.where("fact = 'scope' and parent is null").select("file")))
    return _imports(facts, modules)[0].drop("alone")


def _starred(stars: DataFrame, exports: DataFrame) -> DataFrame | None:
    """What modules hold through ``stars`` (importer, star, module_file) at their top, also through stars of stars: rows like
    ``exports``. A module's own names come first, then the first star; names that begin with an underscore don't pass."""
    every, new, out = exports, exports, None
    while True:
        passed = stars.join(new, "module_file").where(~F.col("imported").startswith("_"))
        best = passed.groupBy(F.col("importer").alias("module_file"), "imported").agg(F.min_by(F.struct("fact", "met_file", "met_ord"), F.struct("star", "met_file", "met_ord")).alias("b"))
        new = written(best.select("module_file", "imported", "b.fact", "b.met_file", "b.met_ord").join(every.select("module_file", "imported"), ["module_file", "imported"], "left_anti"), "starred")
        if new.isEmpty():
            return out
        out = new if out is None else out.unionByName(new)
        every = every.unionByName(new)


class Extent(NamedTuple):
    """Whether a tree has star imports, and the most segments of a reference, a base and a type."""

    stars: bool
    refs: int
    bases: int
    types: int


def extent(facts: DataFrame) -> Extent:
    most = lambda fact: F.max(F.when(F.col("fact") == fact, F.size("parts")))
    found = facts.agg(F.max((F.col("fact") == "import") & (F.col("kind") == "star")).alias("s"), most("ref").alias("r"), most("base").alias("b"), F.max(F.size(F.split("type_name", r"\."))).alias("t")).first()
    return Extent(bool(found["s"]), *(max(1, found[c] or 1) for c in ("r", "b", "t")))


def _imports(facts: DataFrame, modules: DataFrame, has_stars: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``resolve_imports``, and what modules hold through stars."""
    exports = facts.where((F.col("fact").isin("def", "import")) & F.col("binds") & (F.col("scope") == module_scope()) & (F.col("kind") != "property"))
    exports = exports.select(F.col("file").alias("module_file"), F.col("name").alias("imported"), "fact", F.col("file").alias("met_file"), F.col("ord").alias("met_ord"))
    named = F.col("kind") == "named"
    # the scope of most imports is the module's, which the file tells
    imports = facts.where("fact = 'import'").select("file", "ord", "name", "kind", F.when(F.col("scope") == module_scope(), "").otherwise(F.col("scope")).alias("scope"), told_in_file(facts, "alone"), "imported", absolute(F.col("file"), F.col("module")).alias("module"))
    # only what begins like a module of the tree is looked for
    tops = written(modules.select(F.split_part("module", F.lit("."), F.lit(1)).alias("top")).distinct().withColumn("known", F.lit(True)), "tops")
    first = F.when((F.col("module") == "") & named, F.col("imported")).otherwise(F.col("module"))
    imports = imports.withColumn("top", F.split_part(first, F.lit("."), F.lit(1))).join(tops, "top", "left").drop("top")
    at_module = modules.select("module", F.col("file").alias("module_file"))
    starred = None
    if has_stars:
        stars = written(imports.where("known and kind = 'star' and scope = ''").join(at_module, "module").select(F.col("file").alias("importer"), F.col("ord").alias("star"), "module_file"), "stars")
        starred = None if stars.isEmpty() else _starred(stars, exports)
    every = exports if starred is None else exports.unionByName(starred)
    nothing = {"fact": F.lit(None).cast("string"), "met_file": F.lit(None).cast("string"), "met_ord": F.lit(None).cast("int")}
    found = imports.where(F.col("known") & named).join(at_module, "module", "left").join(every, ["module_file", "imported"], "left")
    whole = imports.where(F.col("known") & ~named).join(at_module, "module", "left").withColumns(nothing)
    outside = imports.where("known is null").withColumns({"module_file": F.lit(None).cast("string")} | nothing)
    met = written(found.unionByName(whole).unionByName(outside), "met")
    # a submodule is asked for only where its package defines no such name
    asks = F.coalesce(F.col("known") & named & ~F.col("fact").eqNullSafe("def"), F.lit(False))
    member = F.concat_ws(".", F.when(F.col("module") != "", F.col("module")), "imported")
    at_member = modules.select(F.col("module").alias("member"), F.col("file").alias("member_file"))
    asked = written(met.where(asks).withColumn("member", member).join(at_member, "member", "left").drop("member"), "asked")
    met = met.where(~asks).withColumn("member_file", F.lit(None).cast("string")).unionByName(asked).withColumn("of_tree", F.when(F.col("module") != "", F.col("known")))
    whole = F.when(named, F.col("member_file")).otherwise(F.col("module_file"))
    hops = met.select(
        "file", "ord", "name", "kind", "scope", "alone", "module", "of_tree", whole.alias("whole"), F.when(named & (F.col("fact") == "def"), F.col("met_file")).alias("def_file"), F.when(named & (F.col("fact") == "def"), F.col("met_ord")).alias("def_ord"),
        F.when(named & F.col("module_file").isNull() | ~named, whole).alias("sub_file"), F.when(named & (F.col("fact") == "import"), F.col("met_file")).alias("next_file"), F.when(named & (F.col("fact") == "import"), F.col("met_ord")).alias("next_ord"),
    )
    going = hops.where("next_file is not null").select("file", "ord", "def_file", "def_ord", "sub_file", "next_file", "next_ord")
    n = going.count()
    ended = None
    if n:
        ends = hops.select(F.col("file").alias("next_file"), F.col("ord").alias("next_ord"), F.col("def_file").alias("d"), F.col("def_ord").alias("o"), F.coalesce("sub_file", F.when(F.col("def_file").isNull() & F.col("next_file").isNull(), F.col("whole"))).alias("s"), F.col("next_file").alias("f"), F.col("next_ord").alias("g"))
        while n:
            # whatever the next import leads to by now; its own rows double the reach each round
            step = going.select("file", "ord", "next_file", "next_ord").join(ends, ["next_file", "next_ord"]).select("file", "ord", F.col("d").alias("def_file"), F.col("o").alias("def_ord"), F.col("s").alias("sub_file"), F.col("f").alias("next_file"), F.col("g").alias("next_ord"))
            step = written(step, "reexports")
            done = step.where("next_file is null")
            ended = done if ended is None else ended.unionByName(done)
            going = step.where("next_file is not null")
            left = going.count()
            if left == n:
                break
            n = left
            others = ends.join(step.select(F.col("file").alias("next_file"), F.col("ord").alias("next_ord")), ["next_file", "next_ord"], "left_anti")
            ends = written(others.unionByName(step.select(F.col("file").alias("next_file"), F.col("ord").alias("next_ord"), F.col("def_file").alias("d"), F.col("def_ord").alias("o"), F.col("sub_file").alias("s"), F.col("next_file").alias("f"), F.col("next_ord").alias("g"))), "ends") if n else ends
        through = ended.select("file", "ord", F.col("def_file").alias("d"), F.col("def_ord").alias("o"), F.col("sub_file").alias("s"))
        hops = hops.join(through, ["file", "ord"], "left").withColumns({"def_file": F.coalesce("def_file", "d"), "def_ord": F.coalesce("def_ord", "o"), "sub_file": F.coalesce("sub_file", "s")})
    whole = F.when(F.col("kind") != "named", F.col("whole")).otherwise(F.coalesce("sub_file", "whole"))
    outcome = F.when(F.col("def_ord").isNotNull(), "def").when(whole.isNotNull(), "module").when(F.col("of_tree"), "missing").otherwise("external")
    scope = F.when(F.col("scope") == "", module_scope()).otherwise(F.col("scope"))
    out = hops.select("file", "ord", "name", "kind", scope.alias("scope"), "module", outcome.alias("outcome"), F.coalesce("def_file", whole).alias("target_file"), F.col("def_ord").alias("target_ord"), "alone")
    return (written(out, "resolved-imports") if ended is not None else out), starred


def walk(rows: DataFrame, keys: list[str], imports: DataFrame, members: DataFrame, owners: DataFrame | Callable[[], tuple[DataFrame, DataFrame]], longest: int, stars: bool = True) -> DataFrame:
    """(keys..., outcome, target_file, target_ord) of ``rows`` (keys..., file, parts, found, found_ord, stars).

    The root of a chain is what its file says; through an import, what that leads to; of stars, the first whose module has
    the name. Each further segment is a member of what the chain has come to: ``members`` (owner, name, file, ord).
    ``owners`` (file, ord, owner) tells which scope holds the members of a definition: only of those that a chain goes on
    from, not of every member. If ``members`` are only those of modules, ``owners`` makes the owners and all members once a chain
    goes on from a definition. A chain whose segment
    isn't found has no outcome. Rows with a ``settled`` definition of their file need no join. ``longest`` is the most segments of a chain, ``stars`` whether there are star imports.
    """
    via = imports.select(F.col("file").alias("_file"), F.col("ord").alias("_ord"), F.col("outcome").alias("_out"), F.col("target_file").alias("_tf"), F.col("target_ord").alias("_to"))
    to = ["owner", F.col("name").alias("segment"), F.col("file").alias("to_file"), F.col("ord").alias("to_ord")]
    steps = members.select(*to)
    kept = (rows.where("settled is null") if "settled" in rows.columns else rows).select(*keys, "file", "parts", "found", "found_ord", "stars")
    # what the file itself says needs no join; only names that an import binds go to the imports
    own = F.when(F.col("found") == "def", F.col("file")), F.when(F.col("found") == "def", F.col("found_ord"))
    start = kept.where("found = 'def' or found = 'builtin'").select(*keys, "parts", F.when(F.col("found") == "def", "def").otherwise("external").alias("outcome"), own[0].alias("at_file"), own[1].alias("at_ord"))
    met = kept.where("found = 'import'").join(via, (F.col("file") == F.col("_file")) & (F.col("found_ord") == F.col("_ord")), "left")
    start = start.unionByName(met.select(*keys, "parts", F.when(F.col("_out") == "missing", "external").otherwise(F.col("_out")).alias("outcome"), F.col("_tf").alias("at_file"), F.col("_to").alias("at_ord")))
    if stars:
        each = kept.where("found = 'star'").select(*keys, "file", "parts", F.posexplode("stars").alias("_n", "_star"))
        each = each.join(via, (F.col("file") == F.col("_file")) & (F.col("_star") == F.col("_ord"))).withColumn("owner", module_scope("_tf")).withColumn("segment", F.col("parts")[0])
        each = each.join(steps, ["owner", "segment"], "left")
        told = F.when(F.col("to_file").isNotNull(), F.when(F.col("to_ord").isNull(), "module").otherwise("def"))
        best = each.groupBy(*keys, "parts").agg(F.min_by(F.struct(told.alias("outcome"), "to_file", "to_ord"), F.struct(F.col("to_file").isNull(), told.isNull(), "_n")).alias("b"))
        held = F.when(F.col("parts")[0].isin(*sorted(BUILTINS)), "external")  # what no star has, Python may hold itself
        start = start.unionByName(best.select(*keys, "parts", F.coalesce("b.outcome", held).alias("outcome"), F.col("b.to_file").alias("at_file"), F.col("b.to_ord").alias("at_ord")))
    target = [F.col("at_file").alias("target_file"), F.col("at_ord").alias("target_ord")]
    out = start.where("size(parts) = 1").select(*keys, "outcome", *target)
    if longest > 1:
        # the few rows with further segments are written at each, so that members and owners are read only by those that need them
        in_module = F.col("owner").endswith("#0")
        going = start.where("size(parts) > 1").select(*keys, "parts", "outcome", "at_file", "at_ord")
        for j in range(1, longest):
            going = written(going, "chains")
            out = out.unionByName(going.where(f"size(parts) <= {j} or outcome is null or outcome not in ('def', 'module')").select(*keys, "outcome", *target))
            going = going.where(f"size(parts) > {j} and outcome in ('def', 'module')")
            of_module, of_def = going.where("outcome = 'module'").withColumn("owner", module_scope("at_file")), going.where("outcome = 'def'")
            moved = [of_module.withColumn("segment", F.get("parts", F.lit(j))).join(steps.where(in_module), ["owner", "segment"], "left")] if not of_module.isEmpty() else []
            if not of_def.isEmpty():
                held_by, held = owners() if callable(owners) else (owners, members)
                of = held_by.select(F.col("file").alias("at_file"), F.col("ord").alias("at_ord"), "owner")
                moved.append(of_def.join(of, ["at_file", "at_ord"], "left").withColumn("segment", F.get("parts", F.lit(j))).join(held.select(*to).where(~in_module), ["owner", "segment"], "left"))
            if not moved:
                going = None
                break
            told = F.when(F.col("to_file").isNotNull(), F.when(F.col("to_ord").isNull(), "module").otherwise("def"))
            moved = [m.select(*keys, "parts", told.alias("outcome"), F.col("to_file").alias("at_file"), F.col("to_ord").alias("at_ord")) for m in moved]
            going = moved[0] if len(moved) == 1 else moved[0].unionByName(moved[1])
        if going is not None:
            out = out.unionByName(going.select(*keys, "outcome", *target))
    if "settled" not in rows.columns:
        return out
    return out.unionByName(rows.where("settled >= 0").select(*keys, F.lit("def").alias("outcome"), F.col("file").alias("target_file"), F.col("settled").alias("target_ord")))


def class_scopes(facts: DataFrame) -> DataFrame:
    """(file, ord, owner): classes and the scopes that hold their members."""
    return facts.where("fact = 'def' and kind = 'class'").select("file", "ord", F.col("body").alias("owner"))


def direct_members(facts: DataFrame, imports: DataFrame, modules: DataFrame, starred: DataFrame | None = None) -> DataFrame:
    """(owner, name, file, ord, rank, alone, telling) of what modules and classes hold themselves; of modules also what they import, and submodules.

    ``ord`` is null where the member is a module. ``alone`` tells that its owner has no other member of that name,
    ``telling`` whether it is a class or may have the type of one (null: perhaps).
    """
    # parameters and other names that functions hold can't be asked for by chains
    own = facts.where("fact = 'def' and binds and kind <> 'parameter'").where(~F.coalesce(told_in_file(facts, "inner"), F.lit(False))).select("owner", "name", "file", "ord", F.lit(0).alias("rank"), told_in_file(facts, "alone"), F.expr("kind = 'class' or type_name is not null and found in ('def', 'import', 'star')").alias("telling"))
    brought = imports.where("kind <> 'star' and target_file is not null").where(F.col("scope") == module_scope()).select(F.col("scope").alias("owner"), "name", F.col("target_file").alias("file"), F.col("target_ord").alias("ord"), F.lit(1).alias("rank"), told_in_file(imports, "alone"))
    inside = modules.where("instr(module, '.') > 0").select(F.regexp_replace("module", r"\.[^.]*$", "").alias("module"), F.regexp_extract("module", r"[^.]*$", 0).alias("name"), F.col("file").alias("sub"))
    below = inside.join(modules, "module").where(F.col("file").endswith("__init__.py")).select(module_scope().alias("owner"), "name", F.col("sub").alias("file"), F.lit(None).cast("int").alias("ord"), F.lit(2).alias("rank"), F.lit(False).alias("alone"))
    # what the facts hold isn't written again
    out = own.unionByName(written(brought.unionByName(below), "brought").withColumn("telling", F.lit(None).cast("boolean")))
    if starred is None:
        return out
    named = starred.select(module_scope("module_file").alias("owner"), F.col("imported").alias("name"), "fact", "met_file", "met_ord")
    at_import = imports.where("target_file is not null").select(F.col("file").alias("met_file"), F.col("ord").alias("met_ord"), "target_file", "target_ord")
    through = named.where("fact = 'import'").join(at_import, ["met_file", "met_ord"]).select("owner", "name", F.col("target_file").alias("file"), F.col("target_ord").alias("ord"), F.lit(1).alias("rank"))
    through = through.unionByName(named.where("fact = 'def'").select("owner", "name", F.col("met_file").alias("file"), F.col("met_ord").alias("ord"), F.lit(1).alias("rank")))
    return out.unionByName(written(through.withColumn("alone", F.lit(False)), "starred-members").withColumn("telling", F.lit(None).cast("boolean")))


def _alone(direct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``direct`` members with nothing else of their name beside them, and the others."""
    alone = F.coalesce(told_in_file(direct, "alone"), F.lit(False))
    return direct.where(alone), direct.where(~alone)


def inherited(bases: DataFrame) -> DataFrame:
    """(derived, base, dist): every class with all above it, at the shortest distance, by doubling; cycles end.

    A shortest way of more than ``done`` steps goes through the class that is ``done`` steps up, so only the pairs at that
    distance are carried on: without a second way to a class, each pair is made once.
    """
    reach = written(bases.select("derived", "base").where("derived <> base").distinct().withColumn("dist", F.lit(1)), "inherited")
    done = 1
    while True:
        last = reach.where(F.col("dist") == done).select("derived", F.col("base").alias("via"))
        further = last.join(reach.select(F.col("derived").alias("via"), "base", (F.col("dist") + done).alias("dist")), "via").where("derived <> base")
        further = further.groupBy("derived", "base").agg(F.min("dist").alias("dist")).join(reach.select("derived", "base"), ["derived", "base"], "left_anti")
        new = written(further, "inherited")
        if new.isEmpty():
            return reach
        reach = reach.unionByName(new)
        done *= 2


def _taken_over(direct: DataFrame, bases: DataFrame) -> DataFrame | None:
    """(owner, name, file, ord, rank, dist): members that classes have from those above them and don't hold themselves, nearest
    first. They go down a level a round, only where nothing nearer holds the name, until a round adds none."""
    below = bases.select(F.col("base").alias("owner"), "derived").where("owner <> derived").distinct()
    alone, others = _alone(direct.where(~F.col("owner").endswith("#0")))
    place = F.struct("rank", "file", "ord")
    best = alone.select("owner", "name", place.alias("b")).unionByName(others.groupBy("owner", "name").agg(F.min(place).alias("b")))
    ends = bases.select(F.explode(F.array("derived", "base")).alias("owner")).distinct()
    every = frontier = written(best.join(ends, "owner", "left_semi"), "held")
    out, dist = None, 0
    while True:
        dist += 1
        passed = frontier.join(below, "owner").groupBy(F.col("derived").alias("owner"), "name").agg(F.min("b").alias("b"))
        frontier = written(passed.join(every.select("owner", "name"), ["owner", "name"], "left_anti"), "taken")
        if frontier.isEmpty():
            return out
        new = frontier.select("owner", "name", "b.file", "b.ord", "b.rank", F.lit(float(dist)).alias("dist"))
        out = new if out is None else out.unionByName(new)
        every = every.unionByName(frontier)


def members(facts: DataFrame, direct: DataFrame, bases: DataFrame) -> DataFrame:
    """(owner, name, file, ord, telling): the nearest member of each name. A class's own, then those of classes of its name in its
    file, then what the classes above it hold, nearest first."""
    classes = facts.where("fact = 'def' and kind = 'class'").groupBy("file", "name").agg(F.collect_set("body").alias("each")).where("size(each) > 1")
    same = classes.select(F.explode("each").alias("owner"), "each").select("owner", F.explode("each").alias("other")).where("owner <> other")
    alone, others = _alone(direct)
    every = others.withColumn("dist", F.lit(0.0)).select("owner", "name", "file", "ord", "rank", "dist")
    every = every.unionByName(same.join(others.where(~F.col("owner").endswith("#0")).withColumnRenamed("owner", "other"), "other").select("owner", "name", "file", "ord", "rank", F.lit(0.5).alias("dist")))
    above = None if bases.isEmpty() else _taken_over(direct, bases)
    every = every if above is None else every.unionByName(above)
    return _nearest(alone, every)


def _nearest(alone: DataFrame, others: DataFrame) -> DataFrame:
    """(owner, name, file, ord, telling) of members ``alone``, and of the ``others`` the nearest of each name."""
    others = others if "dist" in others.columns else others.withColumn("dist", F.lit(0.0))
    nearest = others.groupBy("owner", "name").agg(F.min_by(F.struct("file", "ord"), F.struct("dist", "rank", "file", "ord")).alias("b"))
    nearest = written(nearest.select("owner", "name", "b.file", "b.ord"), "members").withColumn("telling", F.lit(None).cast("boolean"))
    telling = F.col("telling") if "telling" in alone.columns else F.lit(None).cast("boolean").alias("telling")
    return nearest.unionByName(alone.select("owner", "name", "file", "ord", telling))


def class_bases(facts: DataFrame, imports: DataFrame, direct: DataFrame, size: Extent) -> DataFrame:
    """(derived, base): scopes of classes, and of the classes of the tree that they extend by a name or a chain."""
    classes = class_scopes(facts)
    alone, others = _alone(direct)
    held = others.groupBy("owner", "name").agg(F.min_by(F.struct("file", "ord"), F.struct("rank", "file", "ord")).alias("b")).select("owner", "name", "b.file", "b.ord").unionByName(alone.select("owner", "name", "file", "ord"))
    rows = facts.where("fact = 'base'").select("file", F.col("of").alias("class_ord"), "ord", told_in_file(facts, "body"), "parts", "found", "found_ord", "stars", *_settled(facts)).withColumn("at", F.col("file"))
    near = rows.where("settled_body is not null").select("at", "class_ord", F.col("body").alias("derived"), _owner_settled().alias("base"))
    found = walk(rows.where("settled is null"), ["at", "class_ord", "ord", "body"], imports, held, classes, size.bases, size.stars).where("outcome = 'def'")
    ends = classes.select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), F.col("owner").alias("base"))
    found = near.unionByName(found.join(ends, ["target_file", "target_ord"]).select("at", "class_ord", F.col("body").alias("derived"), "base"))
    if "body" not in facts.columns or not facts.where("fact = 'base' and body is null").isEmpty():
        found = written(found, "extended")
        named = classes.select(F.col("file").alias("at"), F.col("ord").alias("class_ord"), "owner")
        found = found.where("derived is not null").unionByName(found.where("derived is null").drop("derived").join(named, ["at", "class_ord"]).withColumnRenamed("owner", "derived"))
    return written(found.select("derived", "base").where("derived <> base").distinct(), "bases")


def value_types(facts: DataFrame, imports: DataFrame, members: DataFrame, size: Extent, rounds: int | None = None) -> DataFrame:
    """(file, ord, owner): classes, and names whose value is known to be of one class of the tree, with the scope of its members.

    A type is told by an annotation or a constructor's call; a name that is assigned another's value, or a function's that
    returns a declared type, takes over that one's type. A constructor's parameter without a type takes the one on which
    the arguments of all calls of its class agree; a call that doesn't tell it, or tells another, leaves it unknown. Types
    spread until a round adds none; a type once known stays, so the rounds end.
    """
    classes = class_scopes(facts)
    split = F.split("type_name", r"\.")
    of_row = F.col("file").alias("at")
    what = F.when(F.col("kind").isin("function", "method", "constructor"), "result").otherwise("def")
    typed = lambda fact, what, name, parts: facts.where(f"fact = '{fact}' and {name} is not null and found in ('def', 'import', 'star')").select(what.alias("what"), of_row, "ord", "file", parts.alias("parts"), "found", "found_ord", "stars", *_settled(facts))
    own = typed("def", what, "type_name", split).unionByName(typed("call", F.lit("call"), "name", F.split("name", r"\.")))
    rows = own.unionByName(typed("argument", F.lit("argument"), "type_name", split)).where("settled is null")
    far = walk(rows, ["what", "at", "ord"], imports, members.where("coalesce(telling, true)"), classes, max(size.refs, size.types), size.stars).where("outcome = 'def'")
    far = far.join(classes.select(F.col("file").alias("target_file"), F.col("ord").alias("target_ord"), "owner"), ["target_file", "target_ord"], "left")
    near = own.where("settled >= 0").select("what", "at", "ord", F.col("at").alias("target_file"), F.col("settled").alias("target_ord"), _owner_settled("at").alias("owner"))
    # of calls only those of classes tell a type
    told = written(far.select(*near.columns).unionByName(near).where("what <> 'call' or owner is not null"), "types")

    known = told.where("what in ('def', 'result') and owner is not null").select(F.col("at").alias("file"), "ord", "what", "owner")
    # parameters of constructors, with what each call of their class gives them
    params = facts.where("fact = 'def' and kind = 'parameter' and place is not null")
    told_in = params.select("file", "of", "ord", "name", "place", told_in_file(facts, "inner"), told_in_file(facts, "body"))
    params = told_in.where("body is not null").select("file", "ord", "name", "place", F.col("body").alias("class_scope"))
    elsewhere = told_in.where("body is null and inner is null")
    if not elsewhere.isEmpty():
        makers = facts.where("fact = 'def' and kind = 'constructor'").select("file", F.col("ord").alias("of"), F.col("owner").alias("class_scope"))
        params = params.unionByName(elsewhere.join(makers, ["file", "of"]).select(*params.columns))
    made = told.where("what = 'call'").select("at", F.col("ord").alias("of_call"), F.col("owner").alias("class_scope"))
    inside = F.col("settled") >= 0
    given = facts.where("fact = 'argument' and coalesce(binds, true)").select(F.col("file").alias("at"), F.col("of").alias("of_call"), F.col("name").alias("keyword"), F.col("place").alias("position"), "ord", F.expr("type_name is not null and found in ('def', 'import', 'star')").alias("open"), *_settled(facts))
    given = given.select("at", "of_call", "keyword", "position", F.struct(F.col("ord").alias("argument"), (F.col("open") & F.col("settled").isNull()).alias("open"), F.when(inside, F.col("at")).alias("s_file"), F.when(inside, F.col("settled")).alias("s_ord"), _owner_settled("at").alias("s_owner")).alias("g"))
    asked = params.select("file", "ord", "name", "place", "class_scope").join(made, "class_scope")
    met = asked.join(given, ["at", "of_call"], "left").groupBy("file", "ord", "at", "of_call").agg(F.min_by("g", F.when((F.col("position") == F.col("place")) | (F.col("keyword") == F.col("name")), F.col("g.argument"))).alias("g"))
    met = written(met.select("file", "ord", "at", "g.*"), "asked")
    source = told.where("what = 'argument'").select("at", F.col("ord").alias("argument"), F.col("target_file").alias("s_file"), F.col("target_ord").alias("s_ord"), F.col("owner").alias("s_owner"))
    beyond = met.where("open").select("file", "ord", "at", "argument").join(source, ["at", "argument"], "left")
    ends = ["file", "ord", "s_file", "s_ord", "s_owner"]
    given = met.where("open is null or not open").select(*ends).unionByName(beyond.select(*ends))
    # a parameter to which a call gives what can't be known stays unknown
    given = given.join(given.where("s_ord is null and s_owner is null").select("file", "ord").distinct(), ["file", "ord"], "left_anti")
    alias = told.where("what in ('def', 'result') and owner is null").select(F.col("at").alias("file"), "ord", "what", F.col("target_file").alias("s_file"), F.col("target_ord").alias("s_ord"))
    given = written(given, "given")
    pending = not (given.isEmpty() and alias.isEmpty())
    done = 0
    while pending and (rounds is None or done < rounds):
        done += 1
        at_source = known.select(F.col("file").alias("s_file"), F.col("ord").alias("s_ord"), F.col("owner").alias("is_owner"))
        taken = alias.join(at_source, ["s_file", "s_ord"]).select("file", "ord", "what", F.col("is_owner").alias("owner"), F.lit(0).alias("rank"))
        agreed = given.join(at_source, ["s_file", "s_ord"], "left").groupBy("file", "ord").agg(F.min(F.coalesce("s_owner", "is_owner")).alias("owner"), F.max(F.coalesce("s_owner", "is_owner")).alias("other"), F.count_if(F.coalesce("s_owner", "is_owner").isNull()).alias("untold"))
        agreed = agreed.where("untold = 0 and owner = other").select("file", "ord", F.lit("def").alias("what"), "owner", F.lit(1).alias("rank"))
        new = taken.unionByName(agreed).join(known.select("file", "ord"), ["file", "ord"], "left_anti").groupBy("file", "ord", "what").agg(F.min_by("owner", F.struct("rank", "owner")).alias("owner"))
        new = written(new, "new")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    # a function's type is its result's; its name alone holds nothing
    return classes.unionByName(known.where("what = 'def'").drop("what"))


def resolved(facts: DataFrame, keep: bool = True, across: bool = False) -> Resolved:
    """All that the references of a tree lead to, with the tables on the way. ``facts`` should be a written table.

    Without ``keep`` the references aren't written out, for those who read them once. ``across`` is for facts of names that
    reach beyond their files (``python_facts``): the references are then those alone, as (file, ord, outcome, target_file, target_ord).
    """
    known = Resolved(facts, across)
    if keep:
        known.references = written(known.references, "references")
    return known


def resolve_references(facts: DataFrame) -> DataFrame:
    """(file, ord, line, col, name, kind, scope, holder, outcome, target_file, target_ord) of every reference.

    ``outcome`` is def, module, external (also what Python itself holds) or unresolved. A name is looked up through its
    scopes, then through its import or the stars of its file; a member chain goes on from what its root is: a module, a
    class, or a name whose value's class is known. A segment that isn't found leaves the chain unresolved.
    """
    return resolved(facts).references
