"""Tables of versions, merged on read.

The newest manifest is the state of the store: of every table and project it
lists parts, the base first. A part is a folder of rows, a folder of keys
whose rows in earlier parts no longer count, or both, and a folder of what
each of its files holds of the columns that lookups go by. A change writes
parts of its own size, whatever the project's, and then one manifest;
nothing is changed in place, so readers see all tables of a change or none,
and a write that stops half-way leaves only folders that no manifest names.
``compact`` makes one part of many; readers of the old ones go on, until
``vacuum`` removes what no manifest names.
"""

from __future__ import annotations

import urllib.parse
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import skipping
from .manifests import Conflict, Manifests

__all__ = ["Conflict", "Store"]

# The table schemas.
SCHEMAS = {
    "files": "project_root string, file_path string, file_hash string, module_name string",
    "symbols": "project_root string, file_path string, module_name string, name string, qualname string, kind string, parent_qualname string, start_line int, end_line int, docstring string, source_code string, ord bigint",
    "relations": "project_root string, file_path string, source_qualname string, relation_kind string, target_ref string, target_qualname string, relation_source string, relation_confidence string, ord bigint",
    "search_docs": "project_root string, doc_id string, qualname string, file_path string, source_kind string, title string, text string",
    "doc_vectors": "project_root string, doc_id string, qualname string, embedding array<float>",
}


# The tables' keys, and the columns that lookups go by.
KEYS = {"files": ("project_root", "file_path"), "symbols": ("project_root", "qualname", "file_path", "start_line"), "search_docs": ("project_root", "doc_id"), "doc_vectors": ("project_root", "doc_id")}
INDEXES = {"files": ("file_path",), "symbols": ("qualname", "file_path"), "relations": ("target_qualname", "source_qualname"), "search_docs": ("doc_id",), "doc_vectors": ("doc_id",)}


def repeated_keys(table: str, df: DataFrame) -> DataFrame:
    """Rows' keys that a table would hold more than once."""
    return df.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).where("n > 1") if table in KEYS else df.limit(0)


#: The columns by whose values files are skipped.
LOOKUPS = {"files": ("file_path",), "symbols": ("qualname", "name", "file_path"), "relations": ("target_qualname", "source_qualname", "target_ref", "file_path"), "search_docs": ("doc_id", "qualname"), "doc_vectors": ("doc_id",)}
#: Parts of a table and project; one more, and they are put into one.
MOST_PARTS = 24


@dataclass
class Store:
    """A store under ``root``, a folder that all executors share."""

    spark: SparkSession
    root: str
    _open: dict | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.files = Manifests(self.spark, self.root)

    # --- the manifests ---

    def _numbers(self) -> list[int]:
        return self.files.numbers()

    def _manifest(self, number: int | None = None) -> dict[str, dict[str, list[dict]]]:
        """Parts by table and project; a change's own while one is open."""
        if number is None and self._open is not None:
            return self._open["tables"]
        return self.files.read(self.files.newest() if number is None else number)

    def _versions(self, table: str) -> list[int]:
        """The manifests that changed a table."""
        out, last = [], {}
        for n in self._numbers():
            now = self._manifest(n).get(table, {})
            if now != last:
                out.append(n)
            last = now
        return out

    def _commit(self, base: int, tables: dict[str, dict[str, list[dict]]]) -> None:
        self.files.commit(base, tables)

    def change(self, action):
        """Run ``action``; all its writes become visible together, or none
        where it fails. Changes within a change join it."""
        if self._open is not None:
            return action()
        base = self.files.newest()
        before = self._manifest(base)
        self._open = {"tables": {t: {p: list(parts) for p, parts in of.items()} for t, of in before.items()}, "dropped": {}}
        try:
            out = action()
            done = self._open["tables"]
        finally:
            self._open = None
        if done != before:
            self._commit(base, done)
        return out

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests but the newest ``keep``, and folders that none of
        these names; the number of folders deleted. Not beside a writer."""
        numbers = self._numbers()
        parts = [part for n in numbers[-keep:] for of in self._manifest(n).values() for listed in of.values() for part in listed]
        used = {folder for part in parts for folder in (part["rows"], part["keys"], part["held"]) if folder}
        for n in numbers[:-keep]:
            self.files.delete(n)
        gone = 0
        for table in SCHEMAS:
            for write in self.files.folders(table):
                for name in self.files.folders(table, write):
                    if f"{table}/{write}/{name}" not in used:
                        self.files.remove(table, write, name)
                        gone += 1
            for beside in (f"{table}_keys", f"{table}_held"):
                for write in self.files.folders(beside):
                    if f"{beside}/{write}" not in used:
                        self.files.remove(beside, write)
                        gone += 1
        return gone

    # --- tables ---

    def _folder(self, name: str) -> str:
        return f"{self.files.root}/{name}"

    def _merged(self, table: str, projects: dict[str, list[dict]], rows_of) -> DataFrame:
        """The rows that count of the parts: ``rows_of`` gives the rows of
        the parts of one place, and a key dropped at a place counts for the
        rows of earlier places."""
        out, drops = None, {}
        for place in range(max(map(len, projects.values()), default=0)):
            parts = [parts[place] for _, parts in sorted(projects.items()) if place < len(parts)]
            found = rows_of([p for p in parts if p["rows"]])
            if found is not None:
                found = found.withColumn("_place", F.lit(place))
                out = found if out is None else out.unionByName(found)
            for part in parts:
                if part["keys"]:
                    drops.setdefault(tuple(part["columns"]), {}).setdefault(place, []).append(self._folder(part["keys"]))
        if out is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        for columns, by_place in drops.items():
            gone = None
            for place, folders in by_place.items():
                one = self.spark.read.schema(", ".join(f"{c} string" for c in columns)).parquet(*folders).withColumn("_dropped", F.lit(place))
                gone = one if gone is None else gone.unionByName(one)
            last = gone.groupBy(*columns).agg(F.max("_dropped").alias("_dropped"))
            out = out.join(last, list(columns), "left").where(F.col("_dropped").isNull() | (F.col("_dropped") <= F.col("_place"))).drop("_dropped")
        return out.select(*[c.split()[0] for c in SCHEMAS[table].split(", ")])

    def _parts(self, table: str, project: str | None) -> dict[str, list[dict]]:
        return {p: parts for p, parts in self._manifest().get(table, {}).items() if project is None or p == project}

    def read(self, table: str, project: str | None = None) -> DataFrame:
        """A table, or one project's rows of it, whose folders alone are read."""

        def rows_of(parts: list[dict]) -> DataFrame | None:
            return self.spark.read.schema(SCHEMAS[table]).parquet(*[self._folder(p["rows"]) for p in parts]) if parts else None

        return self._merged(table, self._parts(table, project), rows_of)

    def lookup(self, table: str, project: str, column: str, values: list[str]) -> DataFrame:
        """A project's rows with one of a few values in a column of
        ``LOOKUPS``. Only files that may hold them are opened."""

        def rows_of(parts: list[dict]) -> DataFrame | None:
            out = None
            for part in parts:
                held = self.spark.read.schema(skipping.SCHEMA).parquet(self._folder(part["held"]))
                one = skipping.read_files(self.spark, SCHEMAS[table], self._folder(part["rows"]), self._own(part, skipping.files_with(held, column, values)))
                out = one if out is None else out.unionByName(one)
            return out

        wanted = list(dict.fromkeys(values))
        if not wanted:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self._merged(table, self._parts(table, project), rows_of).where(F.col(column).isin(wanted))

    def _own(self, part: dict, files: list[str]) -> list[str]:
        """Those of the files that lie in the part's own folder: a write of
        several projects has one table of what its files hold."""
        fs = self.files.fs()
        there = {s.getPath().getName() for s in fs.listStatus(self.files.path(part["rows"]))} if files else set()
        return [f for f in files if f in there]

    def write(self, table: str, df: DataFrame, projects: list[str] | None = None) -> None:
        """Put ``df`` in place of the rows of ``projects`` (all by default)."""

        def action() -> None:
            names, write = [c.split()[0] for c in SCHEMAS[table].split(", ")], uuid.uuid4().hex
            rows = df.select(*names, F.col("project_root").alias("_p"))
            rows = rows if projects is None else rows.where(F.col("project_root").isin(projects))
            # in the order of what lookups go by: row groups that cannot match are skipped
            rows = rows.sortWithinPartitions("_p", *INDEXES[table])
            rows.write.partitionBy("_p").parquet(self._folder(f"{table}/{write}"))
            made = {urllib.parse.unquote(name[3:]): f"{table}/{write}/{name}" for name in self.files.folders(table, write) if name.startswith("_p=")}
            held = f"{table}_held/{write}"
            if made:
                written = self.spark.read.schema(f"{SCHEMAS[table]}, _p string").parquet(self._folder(f"{table}/{write}"))
                skipping.file_stats(written, list(LOOKUPS[table])).write.parquet(self._folder(held))
            now = self._open["tables"].setdefault(table, {})
            for p in sorted({*made, *(list(now) if projects is None else projects)}):
                keys = self._open["dropped"].pop((table, p), None)
                part = {"rows": made.get(p), "held": held if p in made else None} | (keys or {"keys": None, "columns": []})
                if keys:
                    now.setdefault(p, []).append(part)
                elif p in made:
                    now[p] = [part]
                else:
                    now.pop(p, None)

        self.change(action)

    def merge(self, table: str, project: str, df: DataFrame, keys: DataFrame) -> None:
        """Add ``df`` to a project's rows, without those that have one of
        ``keys``, rows of string columns of the table. What is written is of
        the size of these two."""

        def action() -> None:
            columns, folder = keys.columns, f"{table}_keys/{uuid.uuid4().hex}"
            keys.distinct().write.parquet(self._folder(folder))
            self._open["dropped"][table, project] = {"keys": folder, "columns": columns}
            self.write(table, df, [project])
            if len(self._manifest().get(table, {}).get(project, [])) > MOST_PARTS:
                self.write(table, self.read(table, project), [project])

        self.change(action)

    def compact(self, project: str) -> None:
        """Each of a project's tables as one part."""

        def action() -> None:
            for table in SCHEMAS:
                if len(self._manifest().get(table, {}).get(project, [])) > 1:
                    self.write(table, self.read(table, project), [project])

        self.change(action)

    def replace_files(self, project: str, files: DataFrame, symbols: DataFrame, relations: DataFrame) -> None:
        """New content of the given files; of their relations only indexed
        ones go. All three tables change together."""
        touched = files.select("project_root", "file_path")

        def action() -> None:
            self.merge("symbols", project, symbols, touched)
            self.merge("relations", project, relations, touched.withColumn("relation_source", F.lit("index")))
            self.merge("files", project, files, touched)

        self.change(action)

    def replace_source(self, project: str, source: str, relations: DataFrame) -> None:
        """All relations of one source of a project."""
        keys = self.spark.createDataFrame([(project, source)], "project_root string, relation_source string")
        self.merge("relations", project, relations, keys)

    def replace_project(self, table: str, project: str, rows: DataFrame) -> None:
        self.write(table, rows, [project])

    def delete_files(self, doomed: DataFrame) -> None:
        """Files with their symbols and indexed relations. Only keys are
        written."""
        projects = [r[0] for r in doomed.select("project_root").distinct().collect()]

        def action() -> None:
            for project in projects:
                keys = doomed.where(F.col("project_root") == project).select("project_root", "file_path")
                for table, gone in (("symbols", keys), ("relations", keys.withColumn("relation_source", F.lit("index"))), ("files", keys)):
                    self.merge(table, project, self.spark.createDataFrame([], SCHEMAS[table]), gone)

        self.change(action)

    def delete_project(self, project: str) -> dict[str, int]:
        """Rows deleted per table."""
        out = {table: self.read(table, project).count() for table in SCHEMAS}

        def action() -> None:
            for table in SCHEMAS:
                self._open["tables"].get(table, {}).pop(project, None)

        self.change(action)
        return out

    def known_files(self, project: str) -> DataFrame:
        return self.read("files", project).select("file_path", "file_hash")

    def rows(self, table: str, project: str, condition: Column | None = None, *order: str) -> DataFrame:
        """The lookups: one project's rows, filtered and in order."""
        out = self.read(table, project)
        out = out.where(condition) if condition is not None else out
        return out.orderBy(*order) if order else out


def inbound(relations: DataFrame, qualname: str) -> DataFrame:
    """Edges to a symbol by its full name, in order."""
    return relations.where(F.col("target_qualname") == qualname).orderBy("source_qualname", "relation_kind")


def inbound_by_name(relations: DataFrame, name: str) -> DataFrame:
    """Edges that name a symbol but were not resolved, in order."""
    return relations.where(F.col("target_qualname").isNull() & (F.col("target_ref") == name)).orderBy("source_qualname", "relation_kind")


def of_kind(relations: DataFrame, kind: str) -> DataFrame:
    return relations.where(F.col("relation_kind") == kind).orderBy("source_qualname", F.coalesce("target_qualname", "target_ref"))


def outbound(relations: DataFrame, source: str) -> DataFrame:
    return relations.where(F.col("source_qualname") == source).orderBy("relation_kind", F.coalesce("target_qualname", "target_ref"))


def import_roots(relations: DataFrame) -> DataFrame:
    """First segments of all import targets."""
    target = F.coalesce("target_qualname", "target_ref")
    return relations.where("relation_kind = 'imports'").select(F.element_at(F.split(target, r"\."), 1).alias("root")).distinct().orderBy("root")


def skipped_path(path: Column, folders: tuple[str, ...], names: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> Column:
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in folders])) | F.element_at(parts, -1).isin(*names)
    for s in suffixes:
        out = out | F.lower(path).endswith(s)
    return out
