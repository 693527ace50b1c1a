"""The engine's front: build, search, context, impact and verification of one
project, each step timed."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..operators import diff, graph, knowledge, search, validate
from ..operators.store import Store
from ..sources import code, documents, facts

STEP_SCHEMA = "run_id string, step_name string, status string, started_at timestamp, finished_at timestamp, duration_ms bigint, error_type string, error_message string"


@dataclass
class Recorder:
    """Timed steps of one run; a failed step is recorded and raised."""

    run_id: str
    rows: list[tuple] = field(default_factory=list)

    def step(self, name: str, action: Callable[[], Any]) -> Any:
        began, clock = datetime.now(UTC).replace(tzinfo=None), time.perf_counter()
        error: Exception | None = None
        try:
            return action()
        except Exception as e:
            error = e
            raise
        finally:
            took = int((time.perf_counter() - clock) * 1000)
            kind = (type(error).__name__, str(error)) if error else (None, None)
            self.rows.append((self.run_id, name, "failed" if error else "ok", began, datetime.now(UTC).replace(tzinfo=None), took, *kind))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, STEP_SCHEMA)


#: Changed files that are opened by name; more are found by reading the tree.
FEW_FILES = 10_000


@dataclass
class Engine:
    """One project in a store. ``knowledge_doc`` is its curated knowledge;
    ``embedder`` turns texts into vectors, a deterministic stand-in by
    default."""

    spark: SparkSession
    store: Store
    project: str
    knowledge_doc: dict | None = None
    embedder: documents.Embedder | None = None

    def _mark(self, df: DataFrame) -> DataFrame:
        return df.select(F.lit(self.project).alias("project_root"), *df.columns)

    def _rows(self, table: str) -> DataFrame:
        return self.store.rows(table, self.project).drop("project_root")

    @property
    def knowledge(self) -> knowledge.Knowledge:
        return knowledge.from_document(self.spark, self.knowledge_doc)

    def build(self, root: str, full: bool = False, recorder: Recorder | None = None) -> dict[str, int]:
        """Bring the index in step with a tree: changed and new files are
        extracted, vanished ones deleted (in a full build too), knowledge
        edges and search documents replaced where they differ."""
        run = recorder or Recorder("build")
        # hashes are kept, contents are not: those of changed files are read again
        scan = run.step("scan", lambda: stored(code.scan(self.spark, root).drop("content"), "scan"))
        states = diff.status(self.store.known_files(self.project), scan, ["file_path"], "file_hash", force=full).persist()
        report = diff.build_report(states).first().asDict()

        def index() -> None:
            changed = states.where("status in ('new', 'changed')")
            if report["indexed"] <= FEW_FILES:
                touched = code.scan(self.spark, root, only=sorted(r[0] for r in changed.select("file_path").collect()))
            else:
                touched = code.scan(self.spark, root).join(changed, "file_path", "left_semi")
            gone = states.where("status = 'deleted'").select(F.lit(self.project).alias("project_root"), "file_path")
            if report["deleted"]:
                self.store.delete_files(gone)
            if report["indexed"]:
                found = code.facts(touched).persist()
                self.store.replace_files(
                    self.project, self._mark(touched.select("file_path", "file_hash", "module_name")), self._mark(code.symbols(found)), self._mark(code.relations(found))
                )
                found.unpersist()

        def edges() -> None:
            rows = knowledge.relations(self.knowledge).withColumn("file_path", F.lit("")).withColumn("ord", F.lit(0).cast("long"))
            self.store.replace_source(self.project, "knowledge", self._mark(rows).select(self.store.read("relations").columns))

        def docs() -> int:
            new = stored(knowledge.search_documents(self._rows("symbols"), self.knowledge), "search_docs")
            changes = stored(diff.set_diff(self._rows("search_docs"), new, ["doc_id"]), "changes")
            changed = changes.count()
            if changed:
                # only documents that are new or differ are embedded again
                fresh = new.join(changes.where("change <> 'removed'"), "doc_id", "left_semi")
                keys = self._mark(changes.select("doc_id"))
                vectors = documents.embedded(fresh.select("doc_id", "qualname", "text"), self.embedder).drop("text")

                def write() -> None:
                    self.store.merge("search_docs", self.project, self._mark(fresh), keys)
                    self.store.merge("doc_vectors", self.project, self._mark(vectors), keys)

                self.store.change(write)
            return changed

        run.step("graph_indexing", index)
        run.step("knowledge_relations", edges)
        report["documents_changed"] = run.step("search_documents", docs)
        states.unpersist()
        return report

    def sync_references(self, artifacts: DataFrame, library: str = "reference_library", force: bool = False) -> dict[str, int | bool]:
        """Index the reference library as a project of its own, unless it is
        there and nothing forces it. ``artifacts`` carry their source text."""
        there = self.store.read("search_docs", library).count()
        if there and not force:
            return {"reference_documents_count": there, "reference_documents_changed": False}
        mark = F.lit(library).alias("project_root")
        docs = documents.reference_documents(artifacts)
        rows = stored(docs.select(mark, "doc_id", "qualname", F.lit("").alias("file_path"), F.lit("reference").alias("source_kind"), "title", "text"), "references")

        def write() -> None:
            self.store.write("search_docs", rows, [library])
            self.store.write("doc_vectors", documents.embedded(rows.select("project_root", "doc_id", "qualname", "text"), self.embedder).drop("text"), [library])

        self.store.change(write)
        return {"reference_documents_count": rows.count(), "reference_documents_changed": True}

    def bundled(self) -> DataFrame:
        return knowledge.bundled(self._rows("symbols"), self.knowledge)

    def similarities(self, query: str, k: int) -> DataFrame:
        asked = documents.embedded(self.spark.createDataFrame([(0, query)], "query_id long, text string"), self.embedder).select("query_id", F.col("embedding").alias("vector"))
        return search.vector_topk(self._rows("doc_vectors"), asked, max(3 * k, 10), "qualname").select(F.col("key").alias("qualname"), "similarity")

    def search(self, query: str, k: int = 5, operation: str = "replace_symbol", vectors: bool = True) -> DataFrame:
        return search.symbol_search(self.bundled(), query, k, operation, self.similarities(query, k) if vectors else None)

    def context(self, qualnames: list[str]) -> DataFrame:
        targets = self.spark.createDataFrame([(q,) for q in qualnames], "qualname string")
        return graph.context_pack(self._rows("symbols"), self._rows("relations"), targets)

    def impact(self, qualname: str, depth: int = 2) -> DataFrame:
        start = self.spark.createDataFrame([(qualname, qualname)], "root string, node string")
        return graph.impact(self._rows("relations"), start, depth)

    def verify(self, request: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Issues and verdicts of patched files (unit, file_path under
        before/, after/ or tests/, source)."""
        symbols = self._rows("symbols")
        project = symbols.where("kind <> 'module'").select(F.col("module_name").alias("module"), "name").unionByName(symbols.where("kind = 'module'").select(F.col("module_name").alias("module"), F.lit("").alias("name")))
        issues = validate.validated(validate.case_of(request, facts.facts(sources), project))
        return issues, validate.report(issues, request)
