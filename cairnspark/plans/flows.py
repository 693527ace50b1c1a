"""Whole runs over one project: analysis, replay, generation, repair and
onboarding. Each step is timed and recorded; a run's bundle is written as
JSON. The models are functions of the caller: they take a request (a mapping)
and give a mapping, or the text of one."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.tables import stored
from ..operators import analysis, bundles, decisions, graph, knowledge, search, validate, workspace
from ..sources import code, documents, facts, state
from ..streaming.events import reindexed
from .engine import Engine, Recorder

Model = Callable[[dict], Mapping | str]
FILES = "file_path string, source string"
# Limits of a request.
RELATED_LIMIT, SOURCE_CHARS, REFERENCES = 12, 1200, 2


def answer(model: Model, request: dict) -> dict:
    """A model's reply as a mapping; one that holds no object raises."""
    found = model(request)
    if isinstance(found, str):
        found = json.loads(documents.recovered(found) or "null")
    if not isinstance(found, Mapping):
        raise ValueError("the reply holds no object")
    return dict(found)


def tree(engine: Engine, root: str) -> DataFrame:
    """(file_path, source) of a source tree."""
    return code.scan(engine.spark, root).select("file_path", F.decode("content", "utf-8").alias("source"))


def request_text(request: Mapping) -> str:
    parts = [request.get("title"), request.get("description"), *(request.get("constraints") or []), *(request.get("notes") or [])]
    return " ".join(str(p).strip() for p in parts if p and str(p).strip())


# --- applying an artefact -------------------------------------------------------


@dataclass
class Applied:
    """A patched copy of a tree: its files, what changed, and the impact."""

    artifact: dict
    files: DataFrame
    changed: list[str]
    errors: list[str]
    diff: dict[str, str]
    impact: list[dict]
    staged: str


def patched(files: DataFrame, symbol: Mapping, artifact: Mapping, tests: list[Mapping] = []) -> DataFrame:  # noqa: B006
    """``files`` with the artefact in the symbol's place or after it, its
    imports edited, and the generated tests added or replaced."""
    after = artifact["operation"] == "insert_after_symbol"
    own = F.col("file_path") == symbol["file_path"]
    start, end = F.lit(int(symbol["start_line"])), F.lit(int(symbol["end_line"]))
    body = ("\n\n" if after else "") + str(artifact["code"]).rstrip("\n")
    new = workspace.spliced(F.col("source"), start, end, F.lit(body), after=after)
    add = F.array(*[F.lit(x) for x in artifact.get("import_changes") or []]).cast("array<string>")
    drop = F.array(*[F.lit(x) for x in artifact.get("removed_imports") or []]).cast("array<string>")
    out = files.withColumn("source", F.when(own, workspace.imports_edited(new, add, drop)).otherwise(F.col("source")))
    if tests:
        made = files.sparkSession.createDataFrame([(t["file_path"], str(t["source_code"]).rstrip("\n") + "\n") for t in tests], FILES)
        out = out.join(made.select("file_path"), "file_path", "left_anti").unionByName(made)
    return out


def apply_artifact(engine: Engine, files: DataFrame, artifact: Mapping, tests: list[Mapping] = []) -> Applied:  # noqa: B006
    """Patch a copy of the project and index it beside the project under a
    name of its own; only changed files are extracted again, and only where
    all of them parse. Where a step fails the copy is dropped."""
    symbol = engine._rows("symbols").where(F.col("qualname") == artifact["target_qualname"]).first()
    if symbol is None:
        raise ValueError(f"unknown symbol {artifact['target_qualname']}")
    staged = f"{engine.project}@{state.new_id('staging')}"
    try:
        after = stored(patched(files, symbol.asDict(), artifact, tests), "patched")
        binary = lambda df: df.select("file_path", F.encode("source", "utf-8").alias("content"))
        diff = {r["file_path"]: r["diff"] for r in workspace.unified_diffs(binary(files), binary(after)).collect()}
        touched = binary(after).where(F.col("file_path").isin(list(diff))).withColumn("file_hash", code.fingerprint(F.col("content"))).withColumn("module_name", code.module_name(F.col("file_path")))
        touched = stored(touched.select("file_path", "file_hash", "module_name", "content"), "touched")
        errors = [r["file_path"] for r in code.parse_errors(code.facts(touched)).collect()]
        if not errors and diff:
            def stage() -> None:
                mark = F.lit(staged).alias("project_root")
                for table in ("files", "symbols", "relations"):
                    engine.store.write(table, engine._rows(table).select(mark, "*"), [staged])
                reindexed(engine.store, staged, touched)

            engine.store.change(stage)
        impact = [r.asDict() for r in engine.impact(artifact["target_qualname"]).orderBy("hops", "caller").collect()]
        return Applied(dict(artifact), after, sorted(diff), errors, diff, impact, staged)
    except Exception:
        engine.store.delete_project(staged)
        raise


def verified(engine: Engine, files: DataFrame, applied: Applied, request: Mapping, tests: list[Mapping] = []) -> tuple[DataFrame, dict]:  # noqa: B006
    """Issues of a patched copy and its report."""
    target = applied.artifact["target_qualname"]
    row = engine._rows("symbols").where(F.col("qualname") == target).first()
    parent = row["parent_qualname"].rsplit(".", 1)[-1] if row["kind"] == "method" and row["parent_qualname"] else None
    unit = ("u", applied.artifact["operation"], target.rsplit(".", 1)[-1], parent, target, request_text(request), applied.changed, row["file_path"])
    asked = engine.spark.createDataFrame([unit], "unit string, operation string, target string, parent string, qualname string, text string, changed array<string>, target_file string")
    own = F.col("file_path") == row["file_path"]
    part = lambda df, prefix: df.select(F.lit("u").alias("unit"), F.concat(F.lit(prefix), "file_path").alias("file_path"), "source")
    sources = part(files.where(own), "before/").unionByName(part(applied.files.where(own), "after/"))
    if tests:
        sources = sources.unionByName(engine.spark.createDataFrame([("u", f"tests/{t['file_path']}", t["source_code"]) for t in tests], "unit string, file_path string, source string"))
    issues, found = engine.verify(asked, sources)
    issues = stored(issues, "issues")
    return issues, validate.report(issues, asked).first().asDict()


# --- requests -------------------------------------------------------------------


def explicit_symbols(symbols: DataFrame, names: list[str], modules: list[str], source_chars: int = SOURCE_CHARS) -> DataFrame:
    """Symbols that a request names: by full name, then by short name within
    the modules already confirmed; a module is confirmed by a full name."""
    rows = symbols.where("kind <> 'module'")
    full = rows.where(F.col("qualname").isin(names)).withColumn("reason", F.lit("explicit_qualname"))
    sure = full.select("module_name").unionByName(symbols.sparkSession.createDataFrame([(m,) for m in modules], "module_name string")).distinct()
    short = rows.where(F.col("name").isin(names)).join(sure, "module_name", "left_semi").join(full.select("qualname"), "qualname", "left_anti").withColumn("reason", F.lit("explicit_name_in_module"))
    out = full.unionByName(short.select(full.columns))
    return out.withColumn("source_excerpt", text.truncated_source(F.coalesce("source_code", F.lit("")), source_chars)).select("qualname", "module_name", "kind", "source_excerpt", "reason").orderBy("reason", "qualname")


def generation_request(engine: Engine, request: Mapping, target: str, references: DataFrame | None = None, artifact: Mapping | None = None) -> tuple[dict, dict]:
    """A generator's request and its metrics: the target's source, its
    context, related symbols within limits, symbols the request names,
    references and what it must reuse."""
    symbols, relations = engine._rows("symbols"), engine._rows("relations")
    row = symbols.where(F.col("qualname") == target).first()
    if row is None:
        raise ValueError(f"unknown symbol {target}")
    pack = json.loads(engine.context([target]).toJSON().first())
    targets = engine.spark.createDataFrame([(target,)], "qualname string")
    related = graph.related_symbols(relations, symbols, targets, 4 * RELATED_LIMIT).drop("rank", "name", "kind", "file_path")
    related = related.withColumnRenamed("direction", "relation_direction").join(symbols, "qualname").withColumn("origin_qualname", F.col("root"))
    related = related.withColumn("role", analysis.relation_role(F.col("relation_kind"), F.col("relation_direction"), F.col("origin_qualname"), F.col("root"))).withColumn("signature", text.signature(F.coalesce("source_code", F.lit(""))))
    chosen = analysis.selected_related(related, ["root"], RELATED_LIMIT, SOURCE_CHARS)
    near = [json.loads(r) for r in analysis.related_payload(chosen.withColumn("relation_source", F.lit("index")).orderBy("rank")).toJSON().collect()]
    said = request_text(request)
    one = engine.spark.range(1).select(decisions.named_symbols(F.lit(said)).alias("names"), decisions.reuse(F.lit(said)).alias("reuse"), decisions.topics(F.lit(said)).alias("topics")).first()
    named = [r.asDict() for r in explicit_symbols(symbols, list(one["names"]), [row["module_name"]]).collect()]
    refs = [] if references is None else [r.asDict() for r in search.reference_topk(references, said, REFERENCES).select("artifact_id", "title", "text", "usage_mode", "score").collect()]
    payload = {
        "change_request": dict(request), "target": {k: row[k] for k in ("qualname", "name", "kind", "file_path", "module_name", "parent_qualname", "source_code", "docstring")},
        "context": pack, "related_symbols": near, "explicit_symbols": named, "reference_artifacts": refs, "reuse_required": bool(one["reuse"]), "topics": list(one["topics"]), "generated_code_artifact": dict(artifact or {}),
    }
    parts = [("target_source", row["source_code"] or ""), *[("related_symbols", x["source_excerpt"]) for x in near], *[("explicit_symbols", x["source_excerpt"]) for x in named], *[("references", x["text"] or "") for x in refs]]
    table = engine.spark.createDataFrame([("r", p, t) for p, t in parts], "request string, part string, text string")
    metrics = {r["part"]: {"items": r["items"], "chars": r["chars"]} for r in bundles.request_metrics(table, ["request"]).collect()}
    return payload, metrics | {"request_chars": workspace.json_size(state.serialised(payload))}


def repair_request(engine: Engine, request: Mapping, target: str, previous: Mapping, issues: DataFrame, most: int = 50) -> tuple[dict, dict]:
    """A generator's request with what it made before and why that failed."""
    payload, metrics = generation_request(engine, request, target, artifact=previous.get("code_artifact"))
    errors = issues.where("severity = 'error'").orderBy("block", "code", "symbol").limit(most)
    diagnostics = [r.asDict() for r in errors.select("code", "block", "file_path", "symbol", "message").collect()]
    return payload | {"previous_result": dict(previous), "diagnostics": diagnostics}, metrics | {"diagnostics": len(diagnostics)}


def artifact_of(engine: Engine, result: Mapping, target: str) -> dict:
    """The artefact in a generator's result; a bad one raises."""
    row = bundles.artifacts(engine.spark.createDataFrame([("u", json.dumps(state.serialised(dict(result)), ensure_ascii=False), target)], "unit string, result string, fallback_target string")).first()
    if row["error"]:
        raise ValueError(f"generator result: {row['error']}")
    return row.asDict()


# --- runs -----------------------------------------------------------------------


@dataclass
class Run:
    """What a run leaves: its steps, and the parts of its bundle."""

    run_id: str
    recorder: Recorder
    bundle: dict = field(default_factory=dict)

    def step(self, name: str, action: Callable[[], Any]) -> Any:
        return self.recorder.step(name, action)


@dataclass
class Flows:
    """Runs over the project of an engine whose tree is at ``root``; bundles
    go to ``runs``, a shared folder, where one is given."""

    engine: Engine
    root: str
    runs: str | None = None
    references: DataFrame | None = None

    def _run(self) -> Run:
        run_id = state.new_id("run")
        return Run(run_id, Recorder(run_id))

    def _merge_plan(self, applied: Applied, verdict: str) -> dict:
        row = self.engine.spark.createDataFrame([(verdict, applied.changed)], "verdict string, changed_files array<string>")
        return {"status": decisions.merge_plan(row).first()["merge_status"], "changed_files": applied.changed}

    def _finish(self, run: Run, request: Mapping, target: str, applied: Applied, report: Mapping, plan: dict) -> Run:
        run.bundle |= {
            "run_id": run.run_id, "project": self.engine.project, "change_request": dict(request), "merge_plan": plan, "verification_report": dict(report),
            "apply_result": {"artifact": applied.artifact, "diff": {"changed_files": applied.changed}, "impact": {"target_qualname": target, "changed_files": applied.changed, "callers": applied.impact}, "errors": applied.errors},
            "execution_summary": {"status": report["verdict"], "operation": applied.artifact["operation"], "selected_target": target}, "ok": plan["status"] == "ready",
            "steps": [{"step_name": r[1], "status": r[2], "duration_ms": r[5]} for r in run.recorder.rows],
        }
        if self.runs:
            state.write_json(self.engine.spark, f"{self.runs.rstrip('/')}/pipeline-{run.run_id}/pipeline_run_{run.run_id}.json", run.bundle)
        return run

    def _prepared(self, run: Run, request: Mapping, target: str, limit: int, searched: bool = True) -> DataFrame:
        run.bundle["build_report"] = run.step("index_build", lambda: self.engine.build(self.root))
        if searched:
            found = run.step("search_primary_target", lambda: [r["qualname"] for r in self.engine.search(request_text(request), limit).collect()])
            run.bundle["search_candidates"] = found
            if target not in found:
                raise ValueError(f"{target} is not in the shortlist")
        return run.step("read_tree", lambda: stored(tree(self.engine, self.root), "tree"))

    def replay(self, request: Mapping, target: str, code_text: str, operation: str = "replace_symbol", limit: int = 5) -> Run:
        """Index, search, context, references, the given code, application in
        a copy, and the plan of a merge."""
        run = self._run()
        files = self._prepared(run, request, target, limit)
        run.bundle["context"] = run.step("context_supporting_code", lambda: json.loads(self.engine.context([target]).toJSON().first()))
        _, run.bundle["metrics"] = run.step("reference_retrieval", lambda: generation_request(self.engine, request, target, self.references))
        artifact = run.step("generation_replay", lambda: artifact_of(self.engine, {"status": "ok", "code_artifact": {"operation": operation, "code": code_text, "target_qualname": target}}, target))
        applied = run.step("apply_staging", lambda: apply_artifact(self.engine, files, artifact))
        report = {"verdict": "verification_failed" if applied.errors else "ready_for_merge_review"}
        plan = run.step("merge_dry_run", lambda: self._merge_plan(applied, report["verdict"]))
        return self._finish(run, request, target, applied, report, plan)

    def generate(self, request: Mapping, target: str, generator: Model, repairer: Model | None = None, limit: int = 5, skip_search: bool = False, repairs: int = 1) -> Run:
        """Request, generation, application and verification; while that
        fails, up to ``repairs`` repairs, of which the best is kept."""
        run = self._run()
        files = self._prepared(run, request, target, limit, not skip_search)
        payload, run.bundle["metrics"] = run.step("generation_request", lambda: generation_request(self.engine, request, target, self.references))
        result = run.step("generation", lambda: answer(generator, payload))
        return self._judged(run, request, target, files, result, repairer, repairs)

    def repair(self, request: Mapping, target: str, previous: Mapping, repairer: Model, limit: int = 5) -> Run:
        """A repair of an earlier result: its issues are found anew."""
        run = self._run()
        files = self._prepared(run, request, target, limit, False)
        return self._judged(run, request, target, files, dict(previous), repairer, 1)

    def _judged(self, run: Run, request: Mapping, target: str, files: DataFrame, result: dict, repairer: Model | None, repairs: int) -> Run:
        tests = list(result.get("generated_tests") or [])
        artifact = run.step("artifact", lambda: artifact_of(self.engine, result, target))
        applied = run.step("apply_staging", lambda: apply_artifact(self.engine, files, artifact, tests))
        issues, report = run.step("verification", lambda: verified(self.engine, files, applied, request, tests))
        for k in range(repairs if repairer else 0):
            if report["verdict"] == "ready_for_merge_review":
                break
            asked, _ = run.step(f"repair_request_{k + 1}", lambda: repair_request(self.engine, request, target, result, issues))
            fixed = run.step(f"repair_{k + 1}", lambda: answer(repairer, asked))
            more = list(fixed.get("generated_tests") or tests)
            try:
                other = run.step(f"repair_apply_{k + 1}", lambda: apply_artifact(self.engine, files, artifact_of(self.engine, fixed, target), more))
                found, rated = run.step(f"repair_verification_{k + 1}", lambda: verified(self.engine, files, other, request, more))
            except ValueError:
                continue  # the step is recorded as failed; the earlier result stands
            if rated["errors"] <= report["errors"]:
                applied, issues, report, result, tests = other, found, rated, fixed, more
        run.bundle["issues"] = [r.asDict() for r in issues.orderBy("block", "code", "symbol").limit(200).collect()]
        plan = run.step("merge_dry_run", lambda: self._merge_plan(applied, report["verdict"]))
        return self._finish(run, request, target, applied, report, plan)

    # --- analysis and onboarding ---

    def analyze(self, requirements: list[Mapping], operation: str | None = None, insert_scope: str | None = None, planner: Model | None = None, reranker: Model | None = None, limit: int = 10) -> dict:
        """Plan, recall, rerank, overrides, context and the session's rows.
        Either model may be missing or fail: its warning is kept and the
        analysis goes on without it."""
        engine, spark = self.engine, self.engine.spark
        warnings: list[str] = []

        def asked(model: Model | None, request: dict, code_: str) -> dict:
            if model is None:
                return {}
            try:
                return answer(model, request)
            except Exception:  # noqa: BLE001  a model that fails is a warning
                warnings.append(code_)
                return {}

        said = " ".join(filter(None, map(request_text, requirements)))
        plan = asked(planner, {"requirements": [dict(r) for r in requirements], "operation": operation}, "analysis_llm_search_plan_failed")
        compact = spark.createDataFrame([(json.dumps(state.serialised(plan)),)], "plan string").select(analysis.compact_plan(F.col("plan")).alias("p")).select("p.*").first()
        planned = compact["operation"]["value"] if compact["operation"] else None
        chosen = operation or (planned if planned in bundles.OPERATIONS else None) or "replace_symbol"
        scope = insert_scope or (compact["insert_scope"]["value"] if compact["insert_scope"] else None)
        session = state.new_session(spark, engine.project, [dict(r) for r in requirements], chosen)

        queries = [said, *compact["search_plan"]["search_queries"]]
        hits = None
        for pos, q in enumerate(dict.fromkeys(x.strip() for x in queries if x.strip())):
            part = engine.search(q, limit, chosen).select("qualname", "score", F.lit(pos).alias("query_pos"))
            hits = part if hits is None else hits.unionByName(part)
        symbols = stored(engine._rows("symbols"), "symbols")
        hits = hits if hits is not None else spark.createDataFrame([], "qualname string, score double, query_pos int")
        names = list(spark.range(1).select(decisions.named_symbols(F.lit(said)).alias("n")).first()["n"])
        best = search.with_hints(search.union_best(hits, "qualname", 12), symbols.where("kind <> 'module'"), names) if names else search.union_best(hits, "qualname", 12)
        # the recall list is a dozen rows and the symbols named outright
        recall = sorted(best.collect(), key=lambda r: (-float(r["score"]), r["qualname"]))
        cards = [{"candidate_id": f"c{i + 1}", "qualname": r["qualname"], "score": float(r["score"])} for i, r in enumerate(recall)]

        rerank = asked(reranker, {"request": said, "cards": cards, "operation": chosen}, "analysis_llm_rerank_failed") if cards else {}
        by_id = {c["candidate_id"]: c["qualname"] for c in cards}
        codes = [w.get("code") for w in rerank.get("warnings") or [] if isinstance(w, Mapping)]
        target = rerank.get("recommended_target") or by_id.get(rerank.get("recommended_candidate_id"))
        ranked = [x.get("candidate_id") for x in rerank.get("ranked_candidates") or [] if isinstance(x, Mapping)]
        alternatives = [x.get("candidate_id") for x in rerank.get("alternatives") or [] if isinstance(x, Mapping)]
        schema = "status string, target string, sure double, review boolean, reranked boolean, plan_review boolean, codes array<string>, found array<string>, ranked array<string>, recommended string, alternatives array<string>"
        status = compact["request_quality"]["status"] or "unknown"
        row = spark.createDataFrame([(status, target, float(rerank.get("target_confidence") or 0.0), bool(rerank.get("manual_review_required")), bool(rerank), bool(compact["manual_review_required"]), codes, list(by_id.values()), ranked, rerank.get("recommended_candidate_id"), alternatives)], schema)
        c = F.col
        row = row.withColumn("codes", analysis.new_file_marked(c("codes"))).withColumn("accepted", analysis.accepted(c("target"), c("sure"), c("review"), c("found")))
        row = row.select(
            "accepted", analysis.request_quality(c("status"), c("target"), c("sure"), c("review")).alias("quality"), analysis.review_required(c("reranked"), c("plan_review"), c("review"), c("codes"), c("accepted"), c("target")).alias("review"),
            analysis.ranked_items(c("ranked"), c("recommended"), c("alternatives")).alias("ids"), "codes", "sure",
        ).first()
        recommended, review = row["accepted"], bool(row["review"])

        kinds = {r["qualname"]: r for r in symbols.where(c("qualname").isin(list(by_id.values()))).select("qualname", "name", "kind", "docstring", "source_code").collect()}
        if chosen == "insert_after_symbol" and not review:
            stubs = spark.createDataFrame([("q", said, x["qualname"], x["name"], x["kind"], x["docstring"] or "", x["source_code"] or "", cards[i]["score"], 0.0, i) for i, q in enumerate(by_id.values()) if (x := kinds.get(q))], "request string, query string, qualname string, name string, kind string, docstring string, source string, score double, confidence double, pos int")
            stubs = stubs.withColumn("is_stub", decisions.stub(c("source"))).withColumn("relevance", decisions.stub_relevance(c("query"), c("name"), c("qualname"), c("docstring")))
            wants = spark.range(1).select(decisions.implementation(F.lit(said)).alias("w")).first()["w"]
            found = decisions.best_stub(stubs, ["request"]).first() if wants else None
            if found is not None:
                chosen, recommended, scope = "replace_symbol", found["qualname"], None
                warnings.append("user_operation_overridden_by_existing_stub")
        role = "target"
        if recommended:
            at = analysis.anchored(spark.createDataFrame([(chosen, scope, recommended)], "operation string, insert_scope string, target string"), symbols).first()
            recommended, role, scope = at["final_target"], at["role"], at["scope"]
        order = {q: i + 1 for i, q in reversed(list(enumerate(by_id[i] for i in row["ids"] if i in by_id)))}
        table = spark.createDataFrame([("a", x["qualname"], i, min(1.0, x["score"] / 22), order.get(x["qualname"]), recommended) for i, x in enumerate(cards)], "request string, qualname string, pos int, confidence double, llm_rank int, recommended string")
        returned = [r["qualname"] for r in analysis.returned_candidates(table, ["request"]).orderBy("rank").collect()]
        kept = spark.createDataFrame([([*warnings, *row["codes"]], review, recommended, row["sure"])], "codes array<string>, review boolean, target string, sure double")
        kept = list(kept.select(analysis.kept_warnings(c("codes"), c("review"), c("target"), c("sure")).alias("k")).first()["k"])
        summary = None
        if recommended and symbols.where(c("qualname") == recommended).count():
            summary = analysis.context_summary(engine.context([recommended])).first().asDict()
        result = {
            "status": "needs_user_decision" if review else "analyzed", "requested_operation": chosen, "insert_scope": scope, "recommended_target": recommended, "target_role": role, "request_quality": row["quality"],
            "candidates": returned, "candidates_count": len(cards), "context_summary": summary, "warnings": kept, "manual_review_required": review,
        }
        session_id = session.first()["session_id"]
        rows = session.unionByName(state.analysed(session, session_id, recommended, chosen, result).select(session.columns))
        return result | {"session_id": session_id, "sessions": rows}

    def onboard(self, projects: DataFrame, project_id: str, knowledge_path: str, enricher: Model | None = None, full: bool = False) -> tuple[DataFrame, dict]:
        """Register, index, enrich, write the knowledge and mark the project
        ready; where a step fails the project's rows go and the registry is as
        it was. ``projects``: project_id, project_root, status."""
        from ..operators import services

        engine, spark = self.engine, self.engine.spark
        row = spark.createDataFrame([(project_id, self.root, "onboarding")], "project_id string, project_root string, status string")
        known = not projects.where(F.col("project_id") == project_id).isEmpty()
        registry = projects if known else services.registered(projects, row)[0]
        run = self._run()
        try:
            report = run.step("index_build", lambda: engine.build(self.root, full))
            symbols = stored(engine._rows("symbols"), "symbols")
            more = run.step("enrichment", lambda: answer(enricher, {"symbols": [r["qualname"] for r in symbols.where("kind <> 'module'").select("qualname").orderBy("qualname").collect()]})) if enricher else None
            kept = normalised_enrichment(more, symbols) if more else (None, [])
            counts = run.step("knowledge", lambda: state.rebuilt_knowledge(spark, knowledge_path, symbols, kept[0]))
            engine.knowledge_doc = state.read_yaml(spark, knowledge_path)
            run.step("reindex_knowledge", lambda: engine.build(self.root))
            ready = registry.withColumn("status", F.when(F.col("project_id") == project_id, "ready").otherwise(F.col("status")))
            return ready, report | {"status": "ready", "warnings": kept[1], "steps": run.recorder.rows} | counts
        except Exception as error:
            if not known:
                services.cleaned_up(engine.store, engine.project)
            return projects, {"status": "failed", "error": f"{type(error).__name__}: {error}", "steps": run.recorder.rows}


def normalised_enrichment(payload: Mapping, symbols: DataFrame) -> tuple[dict, list[str]]:
    """A model's knowledge with module references resolved and names that the
    index lacks dropped, and a warning for each of these."""
    from ..operators import services

    spark, warnings, out = symbols.sparkSession, [], {"modules": {}, "symbols": {}, "requirements": dict(payload.get("requirements") or {})}
    modules = {str(k): v for k, v in (payload.get("modules") or {}).items() if isinstance(v, Mapping)}
    refs = spark.createDataFrame([(m,) for m in modules], "ref string")
    for r in services.module_refs(refs, symbols).collect():
        if r["target"] is None:
            warnings.append(f"unknown module {r['ref']}")
        else:
            out["modules"][r["target"]] = dict(modules[r["ref"]])
    wanted = {str(k): v for k, v in (payload.get("symbols") or {}).items() if isinstance(v, Mapping)}
    rows = spark.createDataFrame([(q,) for q in wanted], "qualname string")
    good, odd = knowledge.unknown_keys(rows, symbols, "qualname")
    out["symbols"] = {r["qualname"]: dict(wanted[r["qualname"]]) for r in good.collect()}
    warnings += [f"unknown symbol {r['qualname']}" for r in odd.orderBy("qualname").collect()]
    return out, sorted(warnings)
