"""Facts of Python sources for the validators: one row for each import,
definition, name, call, attribute, assertion and the like. Parsing is the
only imperative step; rules are joins over these rows."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame

FACTS = "unit string, file_path string, fact string, owner string, name string, detail string, n int, items array<string>, line int"
_ARROW = pa.schema(
    [("unit", pa.string()), ("file_path", pa.string()), ("fact", pa.string()), ("owner", pa.string()), ("name", pa.string()), ("detail", pa.string()), ("n", pa.int32()), ("items", pa.list_(pa.string())), ("line", pa.int32())]
)
#: What a file's own facts have; unit and path come from its row.
_OWN = _ARROW.names[2:]
#: Files that a task reads, about, and facts that it hands over at once.
FILES_A_TASK, ROWS_AT_ONCE = 2_000, 50_000


def dotted(node) -> str | None:
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None


def literal_type(node) -> str | None:
    """The type of a literal; null for other values and for None."""
    if isinstance(node, ast.Constant):
        return None if node.value is None or node.value is Ellipsis else type(node.value).__name__
    kinds = {ast.Dict: "dict", ast.List: "list", ast.Set: "set", ast.Tuple: "tuple", ast.JoinedStr: "str", ast.DictComp: "dict", ast.ListComp: "list", ast.SetComp: "set"}
    return kinds.get(type(node))


def may_be_none(node) -> bool:
    """None, a choice that may be None, or a look-up without a default."""
    if isinstance(node, ast.Constant):
        return node.value is None
    if isinstance(node, ast.IfExp):
        return may_be_none(node.body) or may_be_none(node.orelse)
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "get" and len(node.args) == 1


def sources_of(node) -> list[tuple[str, str]]:
    """Where a value's type comes from: (type, name or call, which)."""
    if isinstance(node, ast.IfExp):
        return [*sources_of(node.body), *sources_of(node.orelse)]
    if isinstance(node, ast.BoolOp):
        return [x for v in node.values for x in sources_of(v)]
    if isinstance(node, ast.NamedExpr):
        return sources_of(node.value)
    if kind := literal_type(node):
        return [("type", kind)]
    if isinstance(node, ast.Name):
        return [("name", node.id)]
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return [("call", node.func.id)]
    return [("type", "?")]


class Reader(ast.NodeVisitor):
    """Walks one module and lists its facts.

    Facts: import, import_from, definition, nested_definition, method,
    load, bind, call, self_read, self_write, self_call, known_attribute,
    field, annotation, assertion, raises, fixture_use, dict_key,
    dunder_dict_return, docstring, attribute_read, attribute_type,
    function_signature, required_keywords, method_keywords, local_import,
    string_keyword, dependency_read, division, value_type, none_value,
    argument_types, argument_type, literal_argument, returns, returned_call,
    assigned_value, used_value, compile_error, text (the file's own, in lower case),
    derived (a class with bases), flow (a variable and where a type comes to it from), value_flow and argument_flow (a
    value handed over, under a variable of its own).
    """

    def __init__(self):
        self.rows: list[dict] = []
        self.classes: list[str] = []
        self.functions: list[ast.AST] = []
        self.flowing: set[int] = set()

    def owner(self) -> str:
        names = [*self.classes, *(f.name for f in self.functions)]
        return ".".join(names)

    def add(self, fact: str, node, name: str | None = None, detail: str | None = None, n: int | None = None, items: list[str] | None = None, owner: str | None = None) -> None:
        self.rows.append({"fact": fact, "owner": self.owner() if owner is None else owner, "name": name, "detail": detail, "n": n, "items": items, "line": getattr(node, "lineno", 0)})

    def flow(self, node, name: str, value) -> None:
        for kind, what in sources_of(value):
            self.add("flow", node, name, kind, items=[what])

    def visit_Import(self, node):
        for a in node.names:
            self.add("import", node, a.name, a.asname or a.name.split(".")[0])
            self.add("bind", node, a.asname or a.name.split(".")[0])

    def visit_ImportFrom(self, node):
        for a in node.names:
            if self.functions:
                self.add("local_import", node, a.asname or a.name)
            self.add("import_from", node, a.name, node.module or "", node.level)
            self.add("bind", node, a.asname or a.name)

    def _definition(self, node, kind: str):
        outer = "method" if self.classes and not self.functions else "nested_definition" if self.functions else "definition"
        self.add(outer, node, node.name, kind, items=[d for x in node.decorator_list if (d := dotted(x.func if isinstance(x, ast.Call) else x))])
        self.add("bind", node, node.name)
        self.add("docstring", node, ".".join(x for x in (self.owner(), node.name) if x), ast.get_docstring(node) or "", owner="")

    def visit_ClassDef(self, node):
        self._definition(node, "class")
        data = any((dotted(d.func if isinstance(d, ast.Call) else d) or "").endswith("dataclass") for d in node.decorator_list)
        init = next((x for x in node.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"), None)
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                self.add("known_attribute", x, x.target.id, owner=node.name)
                if data and init is None:
                    self.add("field", x, x.target.id, ast.unparse(x.annotation), int(x.value is None), owner=node.name)
            elif isinstance(x, ast.Assign):
                for t in x.targets:
                    if isinstance(t, ast.Name):
                        self.add("known_attribute", x, t.id, owner=node.name)
        if node.bases:
            self.add("derived", node, node.name, owner="")
        if init is not None:
            args, gaps = init.args.args[1:], len(init.args.args) - len(init.args.defaults)
            for i, a in enumerate(args, 1):
                self.add("field", init, a.arg, ast.unparse(a.annotation) if a.annotation else "", int(i < gaps), owner=node.name)
            for a, d in zip(init.args.kwonlyargs, init.args.kw_defaults, strict=True):
                self.add("field", init, a.arg, ast.unparse(a.annotation) if a.annotation else "", int(d is None), owner=node.name)
            if init.args.vararg or init.args.kwarg:
                self.add("open_constructor", init, node.name, owner=node.name)
        self.classes.append(node.name)
        held, self.functions = self.functions, []
        self.generic_visit(node)
        self.functions = held
        self.classes.pop()

    def _function(self, node):
        self._definition(node, "async" if isinstance(node, ast.AsyncFunctionDef) else "function")
        every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]
        inner = ".".join(x for x in (self.owner(), node.name) if x)
        for a in every:
            self.add("bind", node, a.arg)
            starred = a in (node.args.vararg, node.args.kwarg)
            self.add("flow", node, a.arg, "note", items=[ast.unparse(a.annotation) if a.annotation and not starred else ""], owner=inner)
        if isinstance(node, ast.AsyncFunctionDef):
            self.add("flow", node, "return", "type", items=["?"], owner=inner)
        plain = [a.arg for a in node.args.args]
        if node.name.startswith("test_"):
            for a in plain[1:] if self.classes and plain[:1] in (["self"], ["cls"]) else plain:
                self.add("fixture_use", node, a, node.name)
        if self.classes and not self.functions and plain:
            required = plain[1 : len(plain) - len(node.args.defaults)]
            self.add("signature", node, node.name, ",".join(required), len(plain) - 1, [*plain[1:], *(a.arg for a in node.args.kwonlyargs)], owner=self.classes[-1])
            self.add("method_keywords", node, node.name, items=[a.arg for a, d in zip(node.args.kwonlyargs, node.args.kw_defaults, strict=True) if d is None], owner=self.classes[-1])
            if node.args.vararg or node.args.kwarg:
                self.add("open_signature", node, node.name, owner=self.classes[-1])
            if not any(isinstance(x, ast.Name) and x.id == plain[0] for b in node.body for x in ast.walk(b)):
                self.add("selfless", node, node.name, owner=self.classes[-1])
        if not self.classes and not self.functions:
            required = plain[: len(plain) - len(node.args.defaults)]
            named = [a.arg for a, d in zip(node.args.kwonlyargs, node.args.kw_defaults, strict=True) if d is None]
            self.add("function_signature", node, node.name, ",".join(required), len(plain), [*plain, *(a.arg for a in node.args.kwonlyargs)])
            self.add("required_keywords", node, node.name, items=named)
            if node.args.vararg or node.args.kwarg:
                self.add("open_signature", node, node.name, owner="")
        if self.classes and not self.functions and node.name == "__init__":
            notes = {a.arg: ast.unparse(a.annotation) for a in node.args.args if a.annotation is not None}
            for x in ast.walk(node):
                if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.value, ast.Name) and x.value.id in notes and (t := dotted(x.targets[0]) or "").startswith("self.") and t.count(".") == 1:
                    self.add("attribute_type", x, t[5:], notes[x.value.id].split("[")[0].split(".")[-1].strip("'\""), owner=self.classes[-1])
        returns = ast.unparse(node.returns) if node.returns else ""
        self.add("returns", node, node.name, returns)
        if not self.functions:
            skip = 1 if self.classes and plain else 0
            self.add("argument_types", node, node.name, items=[ast.unparse(a.annotation) if a.annotation else "" for a in node.args.args[skip:]])
            self._values(node)
        for x in ast.walk(node):
            if isinstance(x, ast.Return) and isinstance(x.value, ast.Call) and (c := dotted(x.value.func)):
                self.add("returned_call", x, c.split(".")[-1], returns, owner=node.name)
            if isinstance(x, ast.Return) and isinstance(x.value, ast.Attribute) and x.value.attr == "__dict__":
                self.add("dunder_dict_return", x, node.name, returns)
        self.functions.append(node)
        self.generic_visit(node)
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _values(self, node):
        """Attributes and subscripts that a function assigns or gives out."""
        for x in ast.walk(node):
            if isinstance(x, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(t, (ast.Attribute, ast.Subscript)):
                        self.add("assigned_value", x, ast.unparse(t), owner=node.name)
            for given in [x.value] if isinstance(x, (ast.Return, ast.Yield)) and x.value else [*x.values] if isinstance(x, ast.Dict) else [*x.args, *(k.value for k in x.keywords)] if isinstance(x, ast.Call) else []:
                if isinstance(given, (ast.Attribute, ast.Subscript)):
                    self.add("used_value", given, ast.unparse(given), owner=node.name)

    def visit_Lambda(self, node):
        for a in [*node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]:
            self.add("bind", node, a.arg)
        self.generic_visit(node)

    def visit_ExceptHandler(self, node):
        if node.name:
            self.add("bind", node, node.name)
        self.generic_visit(node)

    def visit_arg(self, node):
        if node.annotation:
            self.note(node.annotation)

    def visit_AnnAssign(self, node):
        self.note(node.annotation)
        if isinstance(node.target, ast.Name):
            self.flowing.add(id(node.target))
            self.add("flow", node, node.target.id, "note", items=[ast.unparse(node.annotation)])
        self.generic_visit(node)

    def note(self, annotation):
        for x in ast.walk(annotation):
            if isinstance(x, ast.Name):
                self.add("annotation", annotation, x.id)

    def visit_Name(self, node):
        self.add("load" if isinstance(node.ctx, ast.Load) else "bind", node, node.id)
        if not isinstance(node.ctx, ast.Load) and id(node) not in self.flowing:
            self.add("flow", node, node.id, "type", items=["?"])

    def visit_Global(self, node):
        for name in node.names:
            self.add("flow", node, name, "type", items=["?"])

    visit_Nonlocal = visit_Global

    def visit_NamedExpr(self, node):
        self.flowing.add(id(node.target))
        self.flow(node, node.target.id, node.value)
        self.generic_visit(node)

    def visit_Return(self, node):
        if node.value is not None:
            self.flow(node, "return", node.value)
        self.generic_visit(node)

    def visit_Yield(self, node):
        self.add("flow", node, "return", "type", items=["?"])
        self.generic_visit(node)

    visit_YieldFrom = visit_Yield

    def visit_Attribute(self, node):
        if isinstance(node.value, ast.Name) and node.value.id == "self" and self.classes:
            written = isinstance(node.ctx, (ast.Store, ast.Del))
            self.add("self_write" if written else "self_read", node, node.attr, owner=self.classes[-1])
            if written and self.functions and self.functions[0].name == "__init__":
                self.add("known_attribute", node, node.attr, owner=self.classes[-1])
        elif not isinstance(node.ctx, ast.Load):
            self.add("attribute_write", node, node.attr, dotted(node.value) or "")
        elif isinstance(node.value, ast.Name):
            self.add("attribute_read", node, node.attr, node.value.id)
        if isinstance(node.ctx, ast.Load) and self.classes and (d := dotted(node)) and d.startswith("self.") and d.count(".") == 2:
            self.add("dependency_read", node, *d.split(".")[1:], owner=self.classes[-1])
        self.generic_visit(node)

    def visit_Call(self, node):
        name = dotted(node.func)
        if name:
            words = [k.arg for k in node.keywords if k.arg]
            starred = any(isinstance(a, ast.Starred) for a in node.args) or any(k.arg is None for k in node.keywords)
            self.add("call", node, name, "star" if starred else "", len(node.args), words)
            if name.startswith("self.") and name.count(".") == 1 and self.classes:
                self.add("self_call", node, name[5:], "star" if starred else "", len(node.args), words, owner=self.classes[-1])
            last = name.split(".")[-1]
            for k in node.keywords:
                if k.arg and isinstance(k.value, ast.Constant) and isinstance(k.value.value, str):
                    self.add("string_keyword", node, k.arg, last)
                if k.arg and (kind := literal_type(k.value)):
                    self.add("value_type", node, k.arg, last, items=[kind])
                elif k.arg:
                    value = f"@{k.value.lineno}:{k.value.col_offset}"
                    self.flow(node, value, k.value)
                    self.add("value_flow", node, k.arg, last, items=[value])
                if k.arg and may_be_none(k.value):
                    self.add("none_value", node, k.arg, last)
            for i, a in enumerate(node.args):
                if kind := literal_type(a):
                    self.add("argument_type", node, last, kind, i)
                elif not starred:
                    value = f"@{a.lineno}:{a.col_offset}"
                    self.flow(node, value, a)
                    self.add("argument_flow", node, last, value, i)
                if isinstance(a, ast.Constant) and isinstance(a.value, (str, int, float)) and not isinstance(a.value, bool):
                    self.add("literal_argument", node, last, str(a.value), i)
            if name in ("pytest.raises", "raises"):
                self.add("raises", node, name)
            if name.endswith("patch") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                self.add("patch_target", node, node.args[0].value)
        elif isinstance(node.func, ast.Attribute):
            self.add("call", node, node.func.attr, "expression", len(node.args), [k.arg for k in node.keywords if k.arg])
        self.generic_visit(node)

    def visit_BinOp(self, node):
        if isinstance(node.op, ast.Div) and self.classes:
            for side in (node.left, node.right):
                if (d := dotted(side)) and d.startswith("self.") and d.count(".") == 2:
                    self.add("division", node, *d.split(".")[1:], owner=self.classes[-1])
        self.generic_visit(node)

    def visit_Assign(self, node):
        if len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call) and (c := dotted(node.value.func)):
            self.add("instance", node, node.targets[0].id, c)
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.flowing.add(id(t))
                self.flow(node, t.id, node.value)
        self.generic_visit(node)

    def visit_Assert(self, node):
        trivial = isinstance(node.test, ast.Constant) or (isinstance(node.test, ast.Compare) and all(isinstance(x, ast.Constant) for x in (node.test.left, *node.test.comparators)))
        self.add("assertion", node, "trivial" if trivial else "real", items=sorted({d.split(".")[-1] for x in ast.walk(node.test) if (d := dotted(x))} | {x.id for x in ast.walk(node.test) if isinstance(x, ast.Name)}))
        self.generic_visit(node)

    def visit_Dict(self, node):
        for k in node.keys:
            if isinstance(k, ast.Constant) and isinstance(k.value, str):
                self.add("dict_key", k, k.value)
        self.generic_visit(node)

    def visit_Raise(self, node):
        target = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        if target is not None and (name := dotted(target)):
            self.add("exception", node, name)
        self.generic_visit(node)


def _facts_of(path: str, source: str) -> list[dict]:
    """Facts of one file's text."""
    try:
        reader = Reader()
        reader.visit(ast.parse(source))
        found = reader.rows
        try:
            compile(source, path, "exec")
        except (SyntaxError, ValueError) as e:
            found.append({"fact": "compile_error", "detail": str(e), "line": getattr(e, "lineno", 0) or 0})
        if path.startswith("tests/"):
            found.append({"fact": "text", "detail": source.lower(), "line": 0})
    except (SyntaxError, ValueError) as e:
        found = [{"fact": "parse_error", "detail": str(e), "line": getattr(e, "lineno", 0) or 0}]
    return found


def _columns(rows: list[dict]) -> list[list]:
    """Rows as columns, in the order of ``_OWN``."""
    return [[x.get(c) for x in rows] for c in _OWN]


def _read(batches):
    for batch in batches:
        known: dict[tuple[str, str], list[list]] = {}  # equal texts of a batch are read once
        out: list[list] = [[] for _ in _ARROW.names]
        for unit, path, source in zip(*(batch.column(c).to_pylist() for c in ("unit", "file_path", "source")), strict=True):
            found = known.get((path, source))
            if found is None:
                found = known[path, source] = _columns(_facts_of(path, source or ""))
            n = len(found[0])
            for column, values in zip(out, ([unit] * n, [path] * n, *found), strict=True):
                column += values
            if len(out[0]) >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, _ARROW, strict=True)], schema=_ARROW)
                out = [[] for _ in _ARROW.names]
        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, _ARROW, strict=True)], schema=_ARROW)


def spread(rows: DataFrame, *keys: str, a_task: int | None = None) -> DataFrame:
    """``rows`` dealt by their keys to tasks of about ``a_task`` rows, or
    ``FILES_A_TASK``; few rows stay where they are. Reading sources takes
    milliseconds a file, so however few bytes a table has, its rows must not
    lie in one task."""
    n = -(-rows.count() // (a_task or FILES_A_TASK))
    return rows.repartition(n, *keys) if n > 1 else rows


def facts(sources: DataFrame, dealt: bool = False) -> DataFrame:
    """Facts of (unit, file_path, source) rows; a unit is one artefact to
    judge, in whichever version its name tells. The rows are spread over
    tasks, unless the caller has dealt them (``dealt``)."""
    sources = sources.select("unit", "file_path", "source")
    return (sources if dealt else spread(sources, "unit", "file_path")).mapInArrow(_read, FACTS)
