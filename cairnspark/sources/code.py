"""Python source trees as symbol and relation tables.

Files are read by Spark's binary source; parsing is the one step no column
expression can do, so it is an Arrow map over files. Everything after it,
resolution included, is a join.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import first_wins

# Folders that a scan leaves out.
IGNORED = (".git", ".venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".workspaces")

FACT = "file_path string, fact string, source string, kind string, name string, target string, confidence string, parent string, start_line int, end_line int, docstring string, code string, ord long"
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("file_path", "fact", "source", "kind", "name", "target", "confidence", "parent")]
    + [("start_line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("code", pa.string()), ("ord", pa.int64())]
)


def _underscored(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Paths whose names begin with an underscore, as package files' do;
    Spark's own listing takes those for hidden."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        name = found.next().getPath()
        if name.getName().startswith("_") and name.getName().endswith(suffix):
            out.append(name.toString())
    return out


def _contents(batches):
    from pyarrow import fs

    for batch in batches:
        paths, out = batch.column("path").to_pylist(), []
        for p in paths:
            system, inner = fs.FileSystem.from_uri("file://" + p.removeprefix("file:").replace("//", "/") if p.startswith(("file:", "/")) else p)
            with system.open_input_stream(inner) as f:
                out.append(f.read())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], names=["path", "content"])


def fingerprint(content: Column) -> Column:
    """SHA-256 of a file's bytes, lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def scan(spark: SparkSession, root: str, suffix: str = ".py", ignored: tuple[str, ...] = IGNORED, only: list[str] | None = None) -> DataFrame:
    """(file_path, file_hash, module_name, content) of a tree's files, paths
    relative to ``root``. Executors read all contents; only the names of
    package files pass through the driver. Files of no bytes are left out.
    With ``only``, no more than the files of these paths are opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    if only is None:
        files, hidden = reader.load(root).select("path", "content"), _underscored(spark, root, suffix)
    else:
        own = [f"{root.rstrip('/')}/{p}" for p in only]
        # names that Spark's listing hides, and such that it would take for patterns
        hidden = [p for p in own if p.rsplit("/", 1)[-1][:1] in ("_", ".") or set(p) & set("{}[]*?\\")]
        shown = sorted(set(own) - set(hidden))
        files = reader.load(shown).select("path", "content") if shown else spark.createDataFrame([], "path string, content binary")
    if hidden:
        named = spark.createDataFrame([(p,) for p in hidden], "path string")
        files = files.unionByName(named.mapInArrow(_contents, "path string, content binary").where(F.length("content") > 0))
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    rows = files.select(F.replace(plain(F.col("path")), plain(F.lit(root.rstrip("/") + "/")), F.lit("")).alias("file_path"), fingerprint(F.col("content")).alias("file_hash"), "content")
    rows = rows.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*[F.lit(x) for x in ignored])))
    return rows.select("file_path", "file_hash", module_name(F.col("file_path")).alias("module_name"), "content")


def module_name(path: Column) -> Column:
    """The index's name of a file: a package file keeps its ``__init__``."""
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def package_name(path: Column) -> Column:
    """The validators' name of a file: a package file is its package."""
    return F.regexp_replace(module_name(path), r"\.__init__$", "")


class Extractor:
    """Facts of one parsed file: symbols, and edges in their source order."""

    def __init__(self, path: str, module: str, source: str):
        self.path, self.module, self.source = path, module, source
        self.lines, self.rows = source.splitlines(), []
        self.tree = ast.parse(source)

    def emit(self, **row) -> None:
        blank = dict.fromkeys(_ARROW.names)
        self.rows.append(blank | {"file_path": self.path, "ord": len(self.rows)} | row)

    def symbol(self, node, kind: str, qualname: str, parent: str | None) -> None:
        if kind == "module":
            start, end, code = 1, max(1, len(self.lines)), self.source
        else:
            start, end = node.lineno, node.end_lineno
            code = "\n".join(self.lines[start - 1 : end])
        self.emit(fact="symbol", kind=kind, source=qualname, name=qualname.rsplit(".", 1)[-1], parent=parent, start_line=start, end_line=end, docstring=ast.get_docstring(node) or "", code=code)

    def edge(self, source: str, kind: str, ref: str, target: str | None, confidence: str = "medium") -> None:
        self.emit(fact="edge", source=source, kind=kind, name=ref, target=target, confidence=confidence)

    @staticmethod
    def dotted(node) -> str | None:
        names = []
        while isinstance(node, ast.Attribute):
            names.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None

    def imports(self) -> dict[str, str]:
        """Top-level aliases; ``import a.b`` binds its last segment."""
        out = {}
        for node in self.tree.body:
            if isinstance(node, ast.Import):
                out |= {a.asname or a.name.rpartition(".")[2]: a.name for a in node.names}
            elif isinstance(node, ast.ImportFrom):
                base = node.module or ""
                if node.level:
                    package = self.module.split(".")
                    base = ".".join([*package[: max(0, len(package) - node.level)], *([node.module] if node.module else [])])
                out |= {a.asname or a.name: f"{base}.{a.name}" if base else a.name for a in node.names if a.name != "*"}
        return out

    def type_of(self, note) -> str | None:
        """The dotted type that an annotation names."""
        if isinstance(note, ast.Subscript):
            return self.type_of(note.value)
        if isinstance(note, ast.Name):
            return self.known.get(note.id, f"{self.module}.{note.id}")
        dotted = self.dotted(note) if isinstance(note, ast.Attribute) else None
        return self.through_import(dotted) or dotted if dotted else None

    def through_import(self, dotted: str) -> str | None:
        head, _, tail = dotted.partition(".")
        return f"{self.known[head]}.{tail}" if head in self.known and tail else self.known.get(head)

    def local_types(self, function) -> dict[str, str]:
        out = {}
        for node in ast.walk(function):
            if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                found = self.type_of(node.annotation)
            elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                value, found = node.value, None
                if isinstance(value, ast.Call) and isinstance(value.func, ast.Name):
                    found = self.known.get(value.func.id, f"{self.module}.{value.func.id}")
                elif isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute):
                    name = self.dotted(value.func)
                    found = self.through_import(name) if name else None
                elif isinstance(value, ast.Name):
                    found = self.known.get(value.id)
            else:
                continue
            if found:
                out[node.target.id if isinstance(node, ast.AnnAssign) else node.targets[0].id] = found
        return out

    def attribute_types(self, init) -> dict[str, str]:
        """Types of ``self.x`` set from annotated parameters."""
        typed = {a.arg: t for a in init.args.args if a.arg != "self" and a.annotation is not None and (t := self.type_of(a.annotation))}
        out = {}
        for node in ast.walk(init):
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.value, ast.Name) and node.value.id in typed:
                if self.dotted(t := node.targets[0]) == f"self.{getattr(t, 'attr', '')}":
                    out[t.attr] = typed[node.value.id]
        return out

    def call_target(self, func, methods, attributes, local) -> tuple[str, str | None, str] | None:
        """(short name, target, confidence) of a call. A call through an
        attribute of self goes to that attribute's type, whatever stands
        between."""
        if isinstance(func, ast.Name):
            target = self.known.get(func.id) or self.functions.get(func.id)
            return func.id, target, "high" if target else "low"
        dotted = self.dotted(func) if isinstance(func, ast.Attribute) else None
        if not dotted:
            return None
        head, *rest = dotted.split(".")
        ref, target, sure = rest[-1], None, "high"
        if head == "self":
            if len(rest) == 1:
                target = methods.get(ref)
            elif rest[0] in attributes:
                target = f"{attributes[rest[0]]}.{ref}"
        elif head in self.known:
            target = ".".join([self.known[head], *rest])
        elif head in local:
            target, sure = ".".join([local[head], *rest]), "medium"
        return ref, target, sure if target else "low"

    def calls(self, source: str, function, methods, attributes) -> None:
        local = self.local_types(function)
        in_tests = "/tests/" in f"/{self.path}"
        for node in ast.walk(function):
            found = self.call_target(node.func, methods, attributes, local) if isinstance(node, ast.Call) else None
            if found:
                ref, target, sure = found
                self.edge(source, "calls", ref, target, sure)
                if target and in_tests:
                    self.edge(source, "covered_by_test", ref, target, sure)
                if target and ".api." in source and ".services." in target:
                    self.edge(source, "exposed_by_controller", ref, target, sure)

    def run(self) -> list[dict]:
        self.symbol(self.tree, "module", self.module, None)
        self.known = self.imports()
        for alias, target in self.known.items():
            self.edge(self.module, "imports", alias, target)
        self.functions, later = {}, []
        for node in self.tree.body:
            name = f"{self.module}.{getattr(node, 'name', '')}"
            if isinstance(node, ast.FunctionDef):
                self.symbol(node, "function", name, self.module)
                self.edge(self.module, "contains", node.name, name)
                self.functions[node.name] = name
                later.append((0, name, node, {}, {}))
            elif isinstance(node, ast.ClassDef):
                self.symbol(node, "class", name, self.module)
                self.edge(self.module, "contains", node.name, name)
                members = [m for m in node.body if isinstance(m, ast.FunctionDef)]
                methods, attributes = {m.name: f"{name}.{m.name}" for m in members}, {}
                for m in members:
                    self.symbol(m, "method", f"{name}.{m.name}", name)
                    self.edge(name, "contains", m.name, f"{name}.{m.name}")
                    if m.name == "__init__":
                        attributes = self.attribute_types(m)
                    later.append((1, f"{name}.{m.name}", m, methods, attributes))
        for _, name, node, methods, attributes in sorted(later, key=lambda x: x[0]):
            self.calls(name, node, methods, attributes)
        return self.rows


def _extract(batches):
    for batch in batches:
        rows = []
        for path, module, content in zip(*(batch.column(c).to_pylist() for c in ("file_path", "module_name", "content")), strict=True):
            try:
                rows += Extractor(path, module, content.decode("utf-8")).run()
            except (SyntaxError, ValueError) as e:
                rows.append(dict.fromkeys(_ARROW.names) | {"file_path": path, "fact": "error", "docstring": f"{type(e).__name__}: {e}", "ord": 0})
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def facts(files: DataFrame) -> DataFrame:
    """Symbols, edges and parse errors of each file, in source order."""
    return files.select("file_path", "module_name", "content").mapInArrow(_extract, FACT)


def symbols(found: DataFrame) -> DataFrame:
    return found.where("fact = 'symbol'").select(
        "file_path", F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), "/", ".").alias("module_name"), "name", F.col("source").alias("qualname"), "kind",
        F.col("parent").alias("parent_qualname"), "start_line", "end_line", "docstring", F.col("code").alias("source_code"), "ord",
    )


def relations(found: DataFrame) -> DataFrame:
    """Edges, the first of each within its file."""
    edges = found.where("fact = 'edge'").select(
        "file_path", F.col("source").alias("source_qualname"), F.col("kind").alias("relation_kind"), F.col("name").alias("target_ref"), F.col("target").alias("target_qualname"),
        F.lit("index").alias("relation_source"), F.col("confidence").alias("relation_confidence"), "ord",
    )
    return first_wins(edges, ["file_path", "source_qualname", "relation_kind", "target_ref", "target_qualname", "relation_source", "relation_confidence"], ["ord"])


def parse_errors(found: DataFrame) -> DataFrame:
    return found.where("fact = 'error'").select("file_path", F.col("docstring").alias("message"))
