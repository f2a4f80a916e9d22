"""Facts of Python sources: scopes, definitions, references, imports, literals and calls, as one table of tagged rows.

Each file is parsed by itself inside a task, and what its names mean within the file is settled there too: which binding
a name has, what a class or module holds, which definition is around a place. What needs more than one file is joins.
"""

from __future__ import annotations

import ast
import builtins
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: ``scope`` holds a row, ``body`` is the scope that a class or function opens; ``parts`` is a member chain from its root,
#: or the names in an argument; ``type_name`` an annotation, a constructor's name or the name that is assigned; ``depth`` and
#: ``branches`` those inside a function; ``doc`` the first line of a docstring; ``path`` a definition's dotted name, ``name_line`` and ``name_col`` where its name is,
#: ``local`` whether it is inside a function; of a module's scope ``text`` is ``__main__`` where the file has such a block, of a reference ``[`` where it is subscripted.
#: Of the root of ``parts``, of ``type_name``, or of what is called: ``found`` is def, import, star, builtin or null, ``found_ord`` the binding's row and
#: ``stars`` the star imports that may have it. ``binds``: the row is what its name means in ``owner``, the scope that holds
#: it as a member or name. ``holder`` is the row of the function or class around, ``of`` the call or class of an argument or
#: base, ``place`` an argument's or parameter's position (none: by keyword, or the implicit first). ``body`` of a base is its class's,
#: of a constructor's parameter that of the class that it makes; an argument doesn't bind where the file tells that its call is of no class.
#: ``settled`` is the definition to which the whole chain, type or call leads where the file alone tells it (-1: to none whose type
#: could be known; null: other files tell), ``settled_body`` the number of the scope that it opens as a class. ``alone``: nothing
#: else can bear the row's name where it is held; ``inner``: a function holds it, so no chain can ask for it.
SCHEMA = (
    "file string, fact string, id string, scope string, parent string, body string, kind string, name string, module string, imported string, parts array<string>, "
    "bases array<string>, decorators array<string>, type_name string, doc string, text string, depth int, branches int, line int, col int, end_line int, end_col int, ord int, "
    "path string, owner string, binds boolean, found string, found_ord int, stars array<int>, holder int, of int, place int, local boolean, name_line int, name_col int, "
    "settled int, settled_body int, alone boolean, inner boolean"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
INTS = ("depth", "branches", "line", "col", "end_line", "end_col", "ord", "found_ord", "holder", "of", "place", "name_line", "name_col", "settled", "settled_body")
_TYPES = {"array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])
_EMPTY = dict.fromkeys(COLUMNS)
#: Files whose rows are held at a time.
FILES_A_BATCH = 256
_SELF = ("self", "cls")
_CALLED = ("function", "method", "constructor")
#: Fixed pattern: a file with it may be run as a program.
_MAIN = r"""__name__\s*==\s*['"]__main__['"]"""
BUILTINS = frozenset(dir(builtins))
_BRANCHES = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.comprehension, ast.match_case))
#: Fields with contexts and operators, which hold nothing.
_BARE = ("ctx", "op", "ops")
_NESTS = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match))


def chain(node: ast.AST) -> list[str]:
    """Names of ``a.b.c`` from its root; empty where the root is no name."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return [node.id, *reversed(names)] if isinstance(node, ast.Name) else []


def _parameters(a: ast.arguments) -> list[ast.arg]:
    if not (a.posonlyargs or a.vararg or a.kwonlyargs or a.kwarg):
        return a.args
    return [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]


def complexity(node: ast.AST) -> tuple[int, int]:
    """Deepest nesting of statements, and number of branches."""
    deepest = branches = 0
    todo = [(child, 0) for child in _children(node)]
    while todo:
        child, depth = todo.pop()
        kind = child.__class__
        if kind in _NESTS:
            depth += 1
            deepest = max(deepest, depth)
        if kind in _BRANCHES:
            branches += 1
        if kind not in _LEAVES:
            todo += [(c, depth) for c in _children(child)]
    return deepest, branches


def _children(node: ast.AST) -> list[ast.AST]:
    """``ast.iter_child_nodes`` without contexts and operators, which hold nothing."""
    kind, out = node.__class__, []
    if (fields := _FIELDS.get(kind)) is None:
        fields = _FIELDS[kind] = tuple(f for f in node._fields if f not in _BARE)
    for field in fields:
        value = getattr(node, field, None)
        if value.__class__ is list:
            out += [item for item in value if isinstance(item, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


#: By kind of node: the method that visits it, and its fields but for ``_BARE``.
_METHODS: dict[type, Callable] = {}
_FIELDS: dict[type, tuple[str, ...]] = {}
_LEAVES = (ast.Name, ast.Constant, ast.Pass, ast.Break, ast.Continue)


#: All facts, and those that tell what names mean.
_FACTS = frozenset(("scope", "def", "ref", "import", "base", "literal", "call", "argument"))
_BINDING = frozenset(("scope", "def", "import"))
#: Columns for which places are counted in characters.
_COLS = frozenset(("col", "end_col", "name_col"))


class _Walk(ast.NodeVisitor):
    """Emits rows in source order; columns count UTF-16 units from 1."""

    def __init__(self, file: str, source: str, only: frozenset[str] | None = None, columns: frozenset[str] | None = None, across: bool = False):
        self.across = across
        self.only, self.columns = only or _FACTS, columns or frozenset(COLUMNS)
        self.named = not self.columns.isdisjoint(("path", "local"))
        self.placed, self.lined = not _COLS.isdisjoint(self.columns), not self.columns.isdisjoint(("line", "end_line", "name_line"))
        self.file, self.lines, self.rows = file, source.replace("\r\n", "\n").replace("\r", "\n").split("\n"), []
        self.ascii = source.isascii()
        self.lengths = [len(line) for line in self.lines]
        self.scope, self.kind, self.classes, self.outside = f"{file}#0", "module", [], {}
        self.holder, self.outer, self.walrus, self.functions = None, [], self.scope, 0
        self.add("scope", None, id=self.scope, kind="module", name=file, text="__main__" if "text" in self.columns and re.search(_MAIN, source) else None)

    def visit(self, node: ast.AST):
        kind = node.__class__
        if (method := _METHODS.get(kind)) is None:
            method = _METHODS[kind] = getattr(_Walk, "visit_" + kind.__name__, _Walk.generic_visit)
        return method(self, node)

    def generic_visit(self, node: ast.AST) -> None:
        for child in _children(node):
            self.visit(child)

    def column(self, line: int, offset: int) -> int:
        if self.ascii and line <= len(self.lengths):
            length = self.lengths[line - 1]
            return (offset if offset < length else length) + 1
        raw = self.lines[line - 1].encode()[:offset] if line <= len(self.lines) else b""
        return len(raw.decode("utf-8", "replace").encode("utf-16-le")) // 2 + 1

    def skipped(self, fact: str, rows: int = 1) -> None:
        """Rows that nobody asks for keep their numbers and are dropped at the end."""
        self.rows += [{"fact": fact} for _ in range(rows)]

    def add(self, fact: str, node: ast.AST | None, **values) -> None:
        self.put(fact, node, values)

    def put(self, fact: str, node: ast.AST | None, values: dict) -> None:
        rows = self.rows
        if fact not in self.only:
            rows.append({"fact": fact})
            return
        row = _EMPTY.copy()
        row["file"], row["fact"], row["scope"], row["ord"], row["holder"] = self.file, fact, self.scope, len(rows), self.holder
        row.update(values)
        if self.lined and (line := getattr(node, "lineno", None)) is not None:
            end = row["end_line"] = node.end_lineno
            row["line"] = line
            if self.placed:
                row["col"], row["end_col"] = self.column(line, node.col_offset), self.column(end, node.end_col_offset)
        rows.append(row)

    def inside(self, node: ast.AST, kind: str, name: str, body, holder: int | None = None) -> str:
        """Rows of ``body`` in a scope of their own; ``holder`` is the definition that it belongs to, if it is one's body."""
        before = self.scope, self.kind, self.outside, self.holder, self.walrus
        opened = f"{self.file}#{len(self.rows)}"
        self.add("scope", node, id=opened, parent=self.scope, kind=kind, name=name)
        self.scope, self.kind, self.outside = opened, kind, {}
        if holder is not None:
            self.holder = holder
            self.outer.append(name)
        if name != "comprehension":
            self.walrus = opened
        self.functions += kind == "function"
        body(opened)
        self.functions -= kind == "function"
        if holder is not None:
            self.outer.pop()
        self.scope, self.kind, self.outside, self.holder, self.walrus = before
        return opened

    def binds(self, node: ast.AST, name: str, **values) -> None:
        """A definition, in the scope that a ``global`` or ``nonlocal`` names, if there is one."""
        scope = self.outside.get(name, self.scope)
        values["name"], values["scope"] = name, scope
        if self.named:
            values["path"], values["local"] = ".".join([*self.outer, name]), self.functions > 0 and scope != f"{self.file}#0"
        self.put("def", node, values)
        if not self.lined:
            return
        row = self.rows[-1]
        row["name_line"], row["name_col"] = row["line"], row["col"]
        if self.placed and isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            text = self.lines[node.lineno - 1].encode()[node.col_offset :].decode("utf-8", "replace") if node.lineno <= len(self.lines) else ""
            if met := re.match(r"(?:async\s+)?(?:def|class)\s+", text):
                row["name_col"] = row["col"] + met.end()

    def visit_Global(self, node) -> None:
        self.outside |= dict.fromkeys(node.names, f"{self.file}#0")

    def visit_Nonlocal(self, node) -> None:
        parent = {r["id"]: r["parent"] for r in self.rows if r["fact"] == "scope"}.get(self.scope)
        self.outside |= dict.fromkeys(node.names, parent)

    def visit_FunctionDef(self, node) -> None:
        deepest, branches = complexity(node) if self.columns & {"depth", "branches"} else (None, None)
        kind = ("constructor" if node.name == "__init__" else "method") if self.kind == "class" else "function"
        at = len(self.rows)
        doc = (ast.get_docstring(node) or "").split("\n")[0] or None if "doc" in self.columns else None
        static = bool(node.decorator_list) and any(chain(d)[-1:] == ["staticmethod"] for d in node.decorator_list)
        self.binds(node, node.name, kind=kind, decorators=[".".join(chain(d.func if isinstance(d, ast.Call) else d)) for d in node.decorator_list], doc=doc, depth=deepest, branches=branches, type_name=_annotation(node.returns))
        for d in [*node.decorator_list, *node.args.defaults, *(d for d in node.args.kw_defaults if d), *([node.returns] if node.returns else [])]:
            self.visit(d)

        def body(opened: str) -> None:
            a = node.args
            bound = kind in ("method", "constructor") and not static
            makes = self.rows[at]["scope"] if kind == "constructor" else None
            for k, p in enumerate(_parameters(a)):
                own = self.classes[-1] if k == 0 and bound and self.classes else None
                place = k - bound if k < len(a.posonlyargs) + len(a.args) and k >= bound else None
                row = len(self.rows)
                self.binds(p, p.arg, kind="parameter", type_name=_annotation(p.annotation) or (own and own[0]), place=place, of=at, body=makes)
                if own and not p.annotation:
                    self.rows[row] |= {"found": "def", "found_ord": own[1]}
                if p.annotation:
                    self.visit(p.annotation)
            for s in node.body:
                self.visit(s)

        self.rows[at]["body"] = self.inside(node, "function", node.name, body, at)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node) -> None:
        def body(opened: str) -> None:
            a = node.args
            for p in _parameters(a):
                self.binds(p, p.arg, kind="parameter")
            self.visit(node.body)

        for d in [*node.args.defaults, *(d for d in node.args.kw_defaults if d)]:
            self.visit(d)
        self.inside(node, "function", "lambda", body)

    def _comprehension(self, node) -> None:
        def body(opened: str) -> None:
            for g in node.generators:
                self.visit(g)
            for part in (node.key, node.value) if isinstance(node, ast.DictComp) else (node.elt,):
                self.visit(part)

        self.inside(node, "function", "comprehension", body)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension

    def visit_ClassDef(self, node) -> None:
        at = len(self.rows)
        doc = (ast.get_docstring(node) or "").split("\n")[0] or None if "doc" in self.columns else None
        self.binds(node, node.name, kind="class", bases=[".".join(c) for b in node.bases if (c := chain(b))], decorators=[".".join(chain(d.func if isinstance(d, ast.Call) else d)) for d in node.decorator_list], doc=doc)
        for b in [*node.bases, *(k.value for k in node.keywords), *node.decorator_list]:
            self.visit(b)
        bases = []
        for b in node.bases:
            if c := chain(b):
                self.add("base", b, name=".".join(c), parts=c, of=at)
                bases.append(self.rows[-1])

        def body(opened: str) -> None:
            self.classes.append((node.name, at, opened))
            for s in node.body:
                self.visit(s)
            self.classes.pop()

        opened = self.rows[at]["body"] = self.inside(node, "class", node.name, body, at)
        for row in bases:
            row["body"] = opened

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add("import", a, kind="module", name=a.asname or a.name.split(".")[0], module=a.name if a.asname else a.name.split(".")[0], imported=a.name)

    def visit_ImportFrom(self, node) -> None:
        for a in node.names:
            self.add("import", a, kind="star" if a.name == "*" else "named", name=a.asname or a.name, module="." * node.level + (node.module or ""), imported=a.name)

    def visit_Assign(self, node) -> None:
        self.visit(node.value)
        for t in node.targets:
            self._assigned(t, node.value, None)

    def visit_AnnAssign(self, node) -> None:
        self.visit(node.annotation)
        if node.value:
            self.visit(node.value)
        self._assigned(node.target, node.value, _annotation(node.annotation))

    def _assigned(self, target: ast.AST, value: ast.AST | None, kind_of: str | None) -> None:
        made = ".".join(chain(value.func)) if isinstance(value, ast.Call) else value.id if isinstance(value, ast.Name) else None
        text = str(value.value)[:200] if isinstance(value, ast.Constant) else None
        if isinstance(target, ast.Name):
            self.binds(target, target.id, kind="constant" if self.kind == "module" and target.id.isupper() else "variable", type_name=kind_of or made, text=text)
        elif isinstance(target, ast.Attribute) and chain(target)[:1] == ["self"] and len(chain(target)) == 2 and self.classes:
            self.add("def", target, name=target.attr, kind="property", parent=self.classes[-1][0], owner=self.classes[-1][2], type_name=kind_of or made, text=text)
            at = self.column(target.end_lineno, target.end_col_offset - len(target.attr.encode())) if self.placed else None
            self.rows[-1] |= {"path": f"{'.'.join(self.outer[:-1])}.{target.attr}".lstrip("."), "line": target.end_lineno, "col": at, "name_line": target.end_lineno, "name_col": at}
        else:
            self.visit(target)

    def visit_Name(self, node) -> None:
        if node.ctx.__class__ is ast.Store:
            self.binds(node, node.id, kind="variable")
        else:
            self.put("ref", node, {"kind": "identifier", "name": node.id, "parts": [node.id]})

    def visit_AugAssign(self, node) -> None:
        if isinstance(node.target, ast.Name):
            self.add("ref", node.target, kind="identifier", name=node.target.id, parts=[node.target.id])
        else:
            self.visit(node.target)
        self.visit(node.value)

    def visit_NamedExpr(self, node) -> None:
        """The name belongs to the scope around all comprehensions."""
        self.visit(node.value)
        before, self.scope = self.scope, self.walrus
        self._assigned(node.target, node.value, None)
        self.scope = before

    def _captured(self, node: ast.AST, name: str, after: tuple[int, int], type_name: str | None = None) -> None:
        """A binding of a bare ``name`` that has no node of its own: its first place after a line and byte offset."""
        line, offset = after
        while line <= min(node.end_lineno, len(self.lines)):
            found = re.search(rf"\b{re.escape(name)}\b", self.lines[line - 1].encode()[offset:].decode("utf-8", "replace"))
            if found:
                at = offset + len(self.lines[line - 1].encode()[offset:].decode("utf-8", "replace")[: found.start()].encode())
                self.binds(None, name, kind="variable", type_name=type_name, line=line, col=self.column(line, at), end_line=line, end_col=self.column(line, at + len(name.encode())))
                return
            line, offset = line + 1, 0

    def visit_ExceptHandler(self, node) -> None:
        if node.type:
            self.visit(node.type)
        if node.name:
            self._captured(node, node.name, (node.type.end_lineno, node.type.end_col_offset), ".".join(chain(node.type)) or None)
        for s in node.body:
            self.visit(s)

    def visit_MatchAs(self, node) -> None:
        if node.pattern:
            self.visit(node.pattern)
        if node.name:
            self._captured(node, node.name, (node.pattern.end_lineno, node.pattern.end_col_offset) if node.pattern else (node.lineno, node.col_offset))

    def visit_MatchStar(self, node) -> None:
        if node.name:
            self._captured(node, node.name, (node.lineno, node.col_offset))

    def visit_MatchMapping(self, node) -> None:
        self.generic_visit(node)
        if node.rest:
            last = node.patterns[-1] if node.patterns else None
            self._captured(node, node.rest, (last.end_lineno, last.end_col_offset) if last else (node.lineno, node.col_offset))

    def visit_Attribute(self, node) -> None:
        self.visit(node.value)
        if isinstance(node.ctx, ast.Load) and "ref" not in self.only:
            self.skipped("ref")
        elif isinstance(node.ctx, ast.Load):
            end = len(self.rows)
            self.add("ref", node, kind="member", name=node.attr, parts=chain(node) or None)
            if self.placed:
                self.rows[end]["col"] = self.column(node.end_lineno, node.end_col_offset - len(node.attr.encode()))
            self.rows[end]["line"] = node.end_lineno

    def visit_Subscript(self, node) -> None:
        self.visit(node.value)
        if isinstance(node.value, (ast.Name, ast.Attribute)) and self.rows[-1]["fact"] == "ref":
            self.rows[-1]["text"] = "["
        self.visit(node.slice)

    def visit_Call(self, node) -> None:
        self.visit(node.func)
        if not self.only & {"call", "argument"}:
            self.skipped("call", 1 + len(node.args) + len(node.keywords))
            for a in [*node.args, *(k.value for k in node.keywords)]:
                self.visit(a)
            return
        at = len(self.rows)
        name = node.func.id if node.func.__class__ is ast.Name else ".".join(chain(node.func)) or None
        self.put("call", node, {"kind": "call", "name": name, "parts": None if self.across else [a.id if isinstance(a, ast.Name) else "" for a in node.args]})
        for place, value in enumerate(node.args):
            self._argument(value, None, place, at)
        for k in node.keywords:
            self._argument(k.value, k.arg, None, at)
        for a in node.args:
            self.visit(a)
        for k in node.keywords:
            self.visit(k.value)

    def _argument(self, value: ast.AST, name: str | None, place: int | None, of: int) -> None:
        kind = value.__class__
        made = value.id if kind is ast.Name else ".".join(chain(value.func)) if kind is ast.Call else None
        row = {"name": name, "place": place, "of": of, "type_name": made}
        if not self.across:
            row["parts"] = [made] if kind is ast.Name else sorted({n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(value) if isinstance(n, (ast.Name, ast.Attribute))})
        if made in _SELF and self.classes:
            own = self.classes[-1]
            row["type_name"], row["found"], row["found_ord"] = own[0], "def", own[1]
        self.put("argument", value, row)

    def visit_Constant(self, node) -> None:
        if isinstance(node.value, (str, int, float)) and not isinstance(node.value, bool):
            self.add("literal", node, kind=type(node.value).__name__, text=str(node.value)[:200])


def settle(rows: list[dict], columns: frozenset[str] = frozenset(COLUMNS)) -> None:
    """What names mean within their file: marks the rows that bind, and gives references, types and bases their binding.

    Within a scope a definition comes before a named import, and that before the stars; of equal definitions the last
    counts, of equal imports the first. Names of a class's scope aren't seen from functions inside it.
    """
    scopes = {r["id"]: (r["parent"], r["kind"]) for r in rows if r["fact"] == "scope"}
    bound: dict[tuple[str, str], dict] = {}
    held: dict[tuple[str, str], dict] = {}
    stars: dict[str, list[int]] = {}
    for r in rows:
        if r["fact"] == "def":
            if r["kind"] != "property":
                bound[r["scope"], r["name"]] = r
                r["owner"] = r["scope"]
            held[r["owner"], r["name"]] = r
        elif r["fact"] == "import" and r["kind"] == "star":
            stars.setdefault(r["scope"], []).append(r["ord"])
    for r in rows:
        if r["fact"] == "import" and r["kind"] != "star" and (r["scope"], r["name"]) not in bound:
            bound[r["scope"], r["name"]] = r
    for r in held.values():
        r["binds"] = True
    for r in bound.values():
        r["binds"] = r["binds"] or r["fact"] == "import"

    met: dict[tuple[str, str], tuple] = {}

    def look_up(r: dict, name: str) -> bool:
        """Whether anything in the file binds the name; if so, the row tells what."""
        key = r["scope"], name
        if (told := met.get(key)) is None:
            at, near, told = key[0], True, ()
            while at is not None:
                parent, kind = scopes[at]
                if near or kind != "class":
                    if b := bound.get((at, name)):
                        told = b["fact"], b["ord"], None
                        break
                    if at in stars:
                        told = "star", None, stars[at]
                        break
                at, near = parent, False
            met[key] = told
        if told:
            r["found"], r["found_ord"], r["stars"] = told
        return bool(told)

    for r in rows:
        if r["found"] is None:
            fact = r["fact"]
            if fact == "ref" or fact == "base":
                if (parts := r["parts"]) and not look_up(r, parts[0]) and parts[0] in BUILTINS:
                    r["found"] = "builtin"
            elif name := r["name"] if fact == "call" else r["type_name"] if fact == "def" or fact == "argument" else None:
                look_up(r, name.split(".", 1)[0] if "." in name else name)
    if "alone" in columns:
        _alone(rows, scopes, held, stars)
    if "settled" in columns:
        _followed(rows, held)


def _alone(rows: list[dict], scopes: dict, held: dict, stars: dict) -> None:
    """Marks what bears its name alone in the module or class that holds it, and what functions hold.

    A package's submodules and the names of a star may come beside a module's own, and a class beside another of its name.
    """
    module = rows[0]["file"] + "#0" if rows else None
    shared = module in stars or rows and rows[0]["file"].endswith("__init__.py")
    imported: dict[str, int] = {}
    classes: dict[str, int] = {}
    names: dict[str, str] = {}
    for r in rows:
        if r["fact"] == "import" and r["scope"] == module:
            imported[r["name"]] = imported.get(r["name"], 0) + 1
        elif r["fact"] == "scope" and r["kind"] == "class":
            names[r["id"]] = r["name"]
            classes[r["name"]] = classes.get(r["name"], 0) + 1
    for r in held.values():
        kind = scopes.get(r["owner"], (None, None))[1]
        r["inner"] = kind == "function"
        r["alone"] = not shared and r["name"] not in imported if r["owner"] == module else kind == "class" and classes[names[r["owner"]]] == 1
    for r in rows:
        if r["fact"] == "import" and r["scope"] == module:
            r["alone"] = not shared and imported[r["name"]] == 1 and (module, r["name"]) not in held


def _followed(rows: list[dict], held: dict) -> None:
    """Fills ``settled``: chains go on through classes of the file by what these hold themselves, references also through
    names whose type is such a class."""
    defs = {r["ord"]: r for r in rows if r["fact"] == "def"}

    def typed(r: dict) -> str | None:
        if r["kind"] == "class":
            return r["body"]
        if r["kind"] in _CALLED or r["found"] != "def" or not r["type_name"]:
            return None
        end = moved(defs.get(r["found_ord"]), r["type_name"].split("."), False)
        return end["body"] if end and end["kind"] == "class" else None

    def moved(r: dict | None, parts: list[str], through_types: bool) -> dict | None:
        """An empty row where a chain comes to what holds nothing."""
        for name in parts[1:]:
            if r is None:
                return None
            body = r["body"] if r["kind"] == "class" else typed(r) if through_types else None
            if body is None:
                return None if through_types else {}
            r = held.get((body, name))
        return r

    def typable(r: dict) -> bool:
        return bool(r["type_name"] and r["found"] in ("def", "import", "star")) or r["kind"] == "parameter" and r["place"] is not None and defs[r["of"]]["kind"] == "constructor"

    calls = {}
    for r in rows:
        if r["fact"] == "call":
            calls[r["ord"]] = r
        if r["found"] != "def" or (start := defs.get(r["found_ord"])) is None:
            continue
        fact = r["fact"]
        if fact == "ref" or fact == "base":
            parts = r["parts"]
        else:
            name = r["name"] if fact == "call" else r["type_name"]
            parts = name.split(".") if "." in name else (name,)
        end = start if len(parts) == 1 else moved(start, parts, fact == "ref")
        if end is None:
            continue
        is_class = bool(end) and end["kind"] == "class"
        if not end or fact in ("def", "argument") and not is_class and not typable(end):
            r["settled"] = -1
        else:
            r["settled"] = end["ord"]
        if is_class:
            r["settled_body"] = int(end["body"].rsplit("#", 1)[1])
    for r in rows:
        if r["fact"] == "argument" and (call := calls.get(r["of"])):
            r["binds"] = call["found"] in ("import", "star") or call["found"] == "def" and (call["settled"] is None or call["settled_body"] is not None)


def reaching(rows: list[dict]) -> list[dict]:
    """The settled rows without which other files' names could lead elsewhere, or this file's names to other files.

    Left out are inner scopes; references that the file settles, that are Python's own or lead nowhere; calls that are known
    to be of no class, with their arguments; and what functions hold, unless a row that is kept goes on from it.
    """
    defs = {r["ord"]: r for r in rows if r["fact"] == "def"}
    calls = set()
    out, spare = [], set()
    for r in rows:
        fact, found = r["fact"], r["found"]
        if fact == "def":
            if r["kind"] in ("parameter", "variable") and (r["inner"] or not r["binds"]):
                spare.add(r["ord"])
                continue
        elif fact == "ref":
            if found != "import" and found != "star" and (found != "def" or r["settled"] is not None):
                continue
        elif fact == "call":
            if found != "import" and found != "star" and (found != "def" or r["settled"] is not None and r["settled_body"] is None):
                continue
            calls.add(r["ord"])
        elif fact == "argument":
            if r["of"] not in calls:
                continue
        elif fact == "scope" and r["parent"] is not None:
            continue
        out.append(r)
    if not spare:
        return out
    todo = out
    while todo:
        met = {r["found_ord"] if r["settled"] is None else r["settled"] for r in todo if r["found"] == "def"} & spare
        spare -= met
        todo = [defs[n] for n in met]
        out += todo
    return out


def _annotation(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    return ".".join(chain(node)) or None if node is not None else None


def extract_python(file: str, text: str, only: frozenset[str] | None = None, columns: frozenset[str] | None = None, across: bool = False) -> list[dict]:
    """Rows of one file, of ``only`` these facts, with at least these ``columns`` filled; raises where it doesn't parse.

    ``across`` leaves out what doesn't reach beyond the file; all facts that tell names must then be asked for.
    """
    walk = _Walk(file, text, None if only is None else only | _BINDING | ({"call"} if "argument" in only else set()), columns, across)
    walk.visit(ast.parse(text))
    rows = [r for r in walk.rows if r["fact"] in walk.only]
    settle(rows, walk.columns)
    if across:
        rows = reaching(rows)
    return rows if only is None else [r for r in rows if r["fact"] in only]


def _facts(batches: Iterator[pa.RecordBatch], only: frozenset[str] | None, schema: pa.Schema, across: bool = False) -> Iterator[pa.RecordBatch]:
    asked = frozenset(schema.names)
    picked = itemgetter(*schema.names) if len(schema.names) > 1 else lambda r: (r[schema.names[0]],)
    for batch in batches:
        for at in range(0, batch.num_rows, FILES_A_BATCH):
            part = batch.slice(at, FILES_A_BATCH)
            # trees and rows hold no cycles: their counts of references free them
            gc.disable()
            # a file's rows become columns at once, so that few of them are held as dictionaries
            columns: list[list] = [[] for _ in schema.names]
            for file, text in zip(part["rel"].to_pylist(), part["text"].to_pylist()):
                try:
                    rows = extract_python(file, text or "", only, asked, across)
                except (SyntaxError, ValueError, RecursionError):
                    rows = [_EMPTY | {"file": file, "fact": "error", "kind": "parse-failed", "ord": 0}]
                if only is not None and "error" not in only:
                    rows = [r for r in rows if r["fact"] != "error"]
                for column, values in zip(columns, zip(*map(picked, rows))):
                    column += values
            out = pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(columns, schema)], schema=schema)
            gc.enable()
            # facts of a kind stand together, so that a writer by kind seldom changes files
            yield out.take(pc.array_sort_indices(out["fact"])) if "fact" in schema.names else out


def python_facts(files: DataFrame, only: Iterable[str] | None = None, columns: Iterable[str] | None = None, across: bool = False) -> DataFrame:
    """Facts of the rows of ``files`` (rel, text, lang) in Python. A file that doesn't parse gives one row of fact ``error``.

    ``only`` names the facts that are wanted, ``columns`` the columns; the rest isn't handed over.
    ``across``: without the rows that only tell what a file's names mean within it, see ``reaching``.
    """
    kept = None if only is None else frozenset(only)
    asked = set(COLUMNS if columns is None else columns)
    schema = pa.schema([f for f in _ARROW if f.name in asked])
    ddl = ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in asked)
    return files.where("lang = 'python' and text is not null").select("rel", "text").mapInArrow(lambda batches: _facts(batches, kept, schema, across), ddl)
