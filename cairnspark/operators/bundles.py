"""Run bundles as rows: which files a run changed, which of them must not be
copied, and what it is recorded under. ``bundles``: run_id, workspace_path and
the bundle as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .diff import normal_path
from .services import generated_test_path
from .store import skipped_path

_list = "array<string>"
SCHEMA = (
    f"merge_plan struct<changed_files:{_list},excluded_files:{_list}>, "
    f"apply_result struct<impact:struct<changed_files:{_list},changed_symbols:{_list},target_qualname:string>,diff:struct<changed_files:{_list}>,artifact:struct<operation:string,target_qualname:string,parent_qualname:string>>, "
    f"generated_test_apply struct<skipped:boolean,verification_failed:boolean,applied_tests:{_list},excluded_files:{_list},candidate_test_files:{_list}>, "
    f"verification_report struct<summary:struct<generated_test_failed:boolean,generated_test_runtime_only:boolean,generated_test_excluded_files:{_list},generated_test_failed_files:{_list}>>, "
    f"execution_summary struct<status:string,operation:string,selected_target:string,parent_qualname:string,changed_symbols:{_list}>"
)
# Files a diff never shows.
SKIPPED_FOLDERS = (".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", "node_modules")
SKIPPED_SUFFIXES = (".pyc", ".pyo", ".so", ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".sqlite", ".db")


def parsed(bundles: DataFrame) -> DataFrame:
    """The bundles with their parts in the column ``b``."""
    return bundles.withColumn("b", F.from_json("bundle", SCHEMA))


def relative(path: Column, *roots: Column) -> Column:
    """A path without the first root that holds it; blank where it is
    absolute and none does, as it is where it is relative."""
    clean = normal_path(F.trim(F.coalesce(path, F.lit(""))))
    inside = [F.when(F.startswith(clean, F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"))), F.substring(clean, F.length(F.regexp_replace(r, "/+$", "")) + 2, F.length(clean))) for r in roots]
    return F.when(~clean.startswith("/"), clean).otherwise(F.coalesce(*inside, F.lit("")))


def rejected_tests(b: Column) -> Column:
    """Whether the run says in any of its places that its generated tests failed."""
    flags = [b.generated_test_apply.skipped, b.generated_test_apply.verification_failed, b.verification_report.summary.generated_test_failed, b.verification_report.summary.generated_test_runtime_only]
    out = F.coalesce(b.execution_summary.status, F.lit("")) == "generated_test_verification_failed"
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def _listed(rows: DataFrame, lists: list[tuple[Column, Column | None]], roots: list[Column]) -> DataFrame:
    """(run_id, place, file_path, ok) of the lists' paths in their order."""
    none = F.array().cast("array<struct<part:int,file:string>>")

    def part(i: int, c: Column, only: Column | None) -> Column:
        return F.transform(F.coalesce(F.when(only, c) if only is not None else c, F.array().cast(_list)), lambda x: F.struct(F.lit(i).alias("part"), x.alias("file")))

    parts = [part(i, *x) for i, x in enumerate(lists)]
    each = rows.select("run_id", *[r.alias(f"_r{i}") for i, r in enumerate(roots)], F.posexplode(F.concat(none, *parts)).alias("place", "_f"))
    return each.select("run_id", "place", "_f.part", relative(F.col("_f.file"), *[F.col(f"_r{i}") for i in range(len(roots))]).alias("file_path")).where("file_path <> ''")


def _first(rows: DataFrame, key: Column) -> DataFrame:
    """The first row of each (run_id, key), in order."""
    return rows.groupBy("run_id", key.alias("_k")).agg(F.min(F.struct("place", "file_path")).alias("_x")).select("run_id", "_x.place", "_x.file_path")


def changed_lists(b: Column) -> list[Column]:
    return [b.apply_result.impact.changed_files, b.apply_result.diff.changed_files, b.merge_plan.changed_files]


def excluded_files(bundles: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """Files that must not leave the workspace: (run_id, place, file_path),
    each once whatever its letter case, in the order they are found. Where
    generated tests were rejected, their candidates, those applied and every
    generated test among the changed files are excluded too."""
    rows = parsed(bundles)
    b, summary = F.col("b"), F.col("b").verification_report.summary
    bad = rejected_tests(b)
    lists = [
        (b.merge_plan.excluded_files, None), (b.generated_test_apply.excluded_files, None), (summary.generated_test_excluded_files, None), (summary.generated_test_failed_files, None),
        (b.generated_test_apply.candidate_test_files, bad), (b.generated_test_apply.applied_tests, bad), *[(c, bad) for c in changed_lists(b)],
    ]
    each = _listed(rows, lists, [F.col("workspace_path"), *[F.lit(r) for r in roots]])
    return _first(each.where((F.col("part") < 6) | generated_test_path(F.col("file_path"))), F.lower("file_path"))


def changed_files(bundles: DataFrame, roots: tuple[str, ...] = (), include_excluded: bool = False) -> DataFrame:
    """Files a run changed, skipped ones and (in any letter case) excluded ones
    aside: (run_id, place, file_path), each once."""
    each = _listed(parsed(bundles), [(c, None) for c in changed_lists(F.col("b"))], [F.col("workspace_path"), *[F.lit(r) for r in roots]])
    each = each.where(~skipped_path(F.col("file_path"), SKIPPED_FOLDERS, (), SKIPPED_SUFFIXES))
    if not include_excluded:
        gone = excluded_files(bundles, roots).select("run_id", F.lower("file_path").alias("_x")).distinct()
        each = each.withColumn("_x", F.lower("file_path")).join(gone, ["run_id", "_x"], "left_anti")
    return _first(each, F.col("file_path"))


def workspace_details(bundles: DataFrame, sessions: DataFrame, trees: DataFrame | None = None) -> DataFrame:
    """One row per workspace: its run, changed and excluded files and whether
    it is its session's last. ``sessions``: session_id, project_id,
    workspace_id, last_workspace_id, last_run_id. ``trees`` (run_id,
    file_path) stands in for runs that list no changed file."""
    pack = lambda df, name: df.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "file_path"))), lambda x: x.file_path).alias(name))
    changed = changed_files(bundles)
    if trees is not None:
        gone = excluded_files(bundles).select("run_id", F.lower("file_path").alias("_x")).distinct()
        other = trees.join(changed.select("run_id").distinct(), "run_id", "left_anti").withColumn("_x", F.lower("file_path")).join(gone, ["run_id", "_x"], "left_anti")
        changed = changed.unionByName(other.select("run_id", F.lit(0).alias("place"), "file_path"))
    none = F.array().cast(_list)
    out = sessions.withColumnRenamed("last_run_id", "run_id").join(pack(changed, "changed_files"), "run_id", "left").join(pack(excluded_files(bundles), "excluded_files"), "run_id", "left")
    last = F.coalesce(F.col("last_workspace_id") == F.col("workspace_id"), F.lit(False))
    return out.select("workspace_id", "session_id", "project_id", "run_id", F.coalesce("changed_files", none).alias("changed_files"), F.coalesce("excluded_files", none).alias("excluded_files"), last.alias("is_last_workspace"))


def traceability_targets(bundles: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """What a run is recorded under: (run_id, target, kind). An insertion's
    changed symbols where the knowledge has them, else its parent or the
    nearest known modules; other operations their targets, else the changed
    symbols. Tests are never recorded."""
    rows = parsed(bundles).select("run_id", F.col("b").alias("b"))
    b = F.col("b")
    insert = F.coalesce(b.apply_result.artifact.operation, b.execution_summary.operation, F.lit("")) == "insert_after_symbol"
    names = lambda *cs: F.array_distinct(F.filter(F.concat(*[F.coalesce(c, F.array().cast(_list)) for c in cs]), lambda x: (F.coalesce(F.trim(x), F.lit("")) != "") & ~x.startswith("tests.")))
    changed = names(b.apply_result.impact.changed_symbols, b.execution_summary.changed_symbols)
    targets = names(F.array(b.apply_result.artifact.target_qualname, b.apply_result.impact.target_qualname, b.execution_summary.selected_target))
    rows = rows.select("run_id", insert.alias("_insert"), changed.alias("_changed"), F.when(F.size(targets) > 0, targets).otherwise(changed).alias("_targets"), F.coalesce(b.apply_result.artifact.parent_qualname, b.execution_summary.parent_qualname).alias("_parent"))
    plain = rows.where(~F.col("_insert")).select("run_id", F.explode("_targets").alias("target"), F.lit("symbol").alias("kind"))
    made = rows.where("_insert").select("run_id", F.explode_outer("_changed").alias("target"), "_parent")
    known = made.join(symbols.select(F.col("qualname").alias("target")).distinct(), "target", "left_semi").select("run_id", "target", F.lit("symbol").alias("kind"))
    open_ = made.join(known.select("run_id").distinct(), "run_id", "left_anti")
    parents = open_.join(modules.select(F.col("module").alias("_parent")).distinct(), "_parent", "left_semi").select("run_id", F.col("_parent").alias("target"))
    above = graph.longest_prefix(open_.where("target like '%.%'").select("run_id", F.regexp_replace("target", r"\.[^.]+$", "").alias("target")), "target", modules, "module")
    near = above.where("nearest is not null").select("run_id", F.col("nearest").alias("target"))
    return plain.unionByName(known).unionByName(parents.unionByName(near).withColumn("kind", F.lit("module"))).distinct()


def rejected_files(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Generated tests to remove: candidates (run_id, file_path) with a safe
    relative path that the workspace (run_id, file_path) has."""
    path = normal_path(F.trim("file_path"))
    safe = candidates.select("run_id", path.alias("file_path")).where(~F.col("file_path").startswith("/") & ~F.array_contains(F.split("file_path", "/"), "..") & F.col("file_path").rlike(r"^tests/.*\.py$"))
    return safe.distinct().join(files, ["run_id", "file_path"], "left_semi")


def facets(runs: DataFrame, *columns: str) -> DataFrame:
    """(facet, value): the distinct values of each column, sorted."""
    out = None
    for c in columns:
        part = runs.select(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")).where("value is not null").distinct()
        out = part if out is None else out.unionByName(part)
    return out.orderBy("facet", "value")


def embedding_usage(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of embedding calls (texts, chars, prompt_tokens, total_duration
    and load_duration in nanoseconds, model, endpoint): counts and sums,
    seconds to six decimals, distinct models and endpoints."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    seconds = lambda c: F.coalesce(F.round(total(c) / 1e9, 6), F.lit(0.0))
    aggs = [F.count("*").alias("calls"), *[F.coalesce(total(c), F.lit(0)).alias(c) for c in ("texts", "chars", "prompt_tokens")], seconds("total_duration").alias("total_duration_sec"), seconds("load_duration").alias("load_duration_sec")]
    aggs += [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("model", "endpoint")]
    return calls.groupBy(*by).agg(*aggs) if by else calls.agg(*aggs)


def knowledge_counts(modules: DataFrame, symbols: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row: modules, symbols and requirements."""
    one = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    return one(modules, "module", "modules").crossJoin(one(symbols, "qualname", "symbols")).crossJoin(one(requirements, "req_id", "requirements"))


def skipped_sync(docs: DataFrame, reason: str) -> DataFrame:
    """The counters of a synchronisation that did not run: what is there."""
    return docs.agg(F.count("*").alias("documents")).select("documents", F.lit(0).cast("long").alias("changed"), F.lit(True).alias("skipped"), F.lit(reason).alias("reason"))


def request_metrics(parts: DataFrame, by: list[str]) -> DataFrame:
    """Items and characters of a request's parts (by, part, text), a row per
    part and one ``request`` with them all."""
    rolled = parts.rollup(*by, "part").agg(F.grouping_id().alias("_g"), F.count("text").alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return rolled.where("_g < 2").select(*by, F.when(F.col("_g") == 1, "request").otherwise(F.col("part")).alias("part"), "items", "chars")


ARTIFACT = "status string, message string, error_type string, planner_result struct<reason:string,suggested_next_step:string>, code_artifact struct<operation:string,code:string,target_qualname:string,insert_scope:string,expected_new_symbol_kind:string,parent_qualname:string,import_changes:array<string>>"
OPERATIONS = ("replace_symbol", "insert_after_symbol")


def artifacts(results: DataFrame) -> DataFrame:
    """Patch artefacts of generator results (unit, result as JSON, fallback
    target): their fields, or ``error``: a status that is not ok with its
    reason and next step, an unknown operation, or no code."""
    r = results.withColumn("r", F.from_json("result", ARTIFACT))
    a, plan = F.col("r").code_artifact, F.col("r").planner_result
    reason = F.coalesce(F.nullif(F.col("r").message, F.lit("")), F.nullif(plan.reason, F.lit("")), F.nullif(F.col("r").error_type, F.lit("")), F.col("r").status, F.lit("None"))
    step = F.nullif(plan.suggested_next_step, F.lit(""))
    reason = F.when(step.isNotNull() & ~F.contains(reason, step), F.concat(reason, F.lit(". Suggested next step: "), step)).otherwise(reason)
    operation = F.coalesce(a.operation, F.lit("replace_symbol"))
    status = F.coalesce(F.col("r").status, F.lit("None"))
    error = F.when(status != "ok", F.concat(status, F.lit(" ("), reason, F.lit(")"))).when(~operation.isin(*OPERATIONS), F.concat(F.lit("unsupported operation: "), operation)).when(F.coalesce(a.code, F.lit("")) == "", "no code")
    blank = lambda c: F.nullif(c, F.lit(""))
    return r.select(
        "unit", F.coalesce(blank(a.target_qualname), F.col("fallback_target")).alias("target_qualname"), a.code.alias("code"), operation.alias("operation"), blank(a.insert_scope).alias("insert_scope"),
        blank(a.expected_new_symbol_kind).alias("expected_new_symbol_kind"), blank(a.parent_qualname).alias("parent_qualname"), F.coalesce(a.import_changes, F.array().cast(_list)).alias("import_changes"), error.alias("error"),
    )


def distinct_objects(values: Column) -> Column:
    """An array of structs without repeats, by their JSON text (the order of
    fields counts), first ones kept."""
    seen = F.transform(values, lambda v: F.to_json(v))
    return F.filter(values, lambda v, i: F.array_position(seen, F.to_json(v)) == i + 1)
