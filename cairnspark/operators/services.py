"""Lifecycle operators: registries, clean-up, sessions, cards, knowledge
payloads and flows."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import decisions, graph
from .diff import reconciled
from .search import top_per_key
from .store import Store

# Source patterns of user-interface code, name parts of methods
# that set it up, and the points of the card priority.
UI_SOURCE = ("qtoolbar", "addtoolbar", "actionstoolbar", "actions_toolbar", "addaction", "qaction", ".triggered", ".connect", "панель инструментов", "кнопк")
UI_SETUP = ("setup", "init", "ui", "toolbar", "action")
CARD_POINTS = {"preferred": 60, "query": 45, "query_in_source": 10, "ui_source": 45, "ui_name": 25, "qualname_in_request": 20, "name_in_request": 12}


# --- registries and clean-up ------------------------------------------------


def registered(projects: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with the new projects whose root is free, and those
    rejected because their root is taken."""
    taken = projects.select("project_root").distinct()
    free = new.join(taken, "project_root", "left_anti")
    return projects.unionByName(free), new.join(taken, "project_root", "left_semi")


def listed(projects: DataFrame, by: str = "path") -> DataFrame:
    """All projects in the order of their registry files."""
    return projects.orderBy(by, "project_id")


def by_root(projects: DataFrame, root: str) -> DataFrame:
    return projects.where(F.regexp_replace("project_root", "/+$", "") == root.rstrip("/"))


def shares_root(projects: DataFrame, project_id: str) -> bool:
    """Whether another registration has the project's root."""
    mine = projects.where(F.col("project_id") == project_id).select("project_root")
    return not projects.where(F.col("project_id") != project_id).join(mine, "project_root", "left_semi").isEmpty()


def cleaned_up(store: Store, project: str) -> dict:
    """Delete a project's rows; counts per table, and a warning where its
    documents and vectors did not match. A failure is a warning too."""
    out: dict = {"deleted": {}, "warnings": []}
    try:
        docs, vectors = (store.read(t).where(F.col("project_root") == project) for t in ("search_docs", "doc_vectors"))
        found = reconciled(docs, vectors).first()
        if found["missing_vectors"] or found["orphan_vectors"]:
            out["warnings"].append(f"documents {found['documents']}, vectors {found['vectors']}")
        out["deleted"] = store.delete_project(project)
    except Exception as e:  # noqa: BLE001  what failed is reported, not raised
        out["warnings"].append(f"{type(e).__name__}: {e}")
    return out


def unregistered(projects: DataFrame, store: Store, project_id: str) -> tuple[DataFrame, dict]:
    """The registry without a project; its data goes unless another
    registration shares the root."""
    row = projects.where(F.col("project_id") == project_id).first()
    rest = projects.where(F.col("project_id") != project_id)
    if row is None:
        return rest, {"deleted": {}, "warnings": ["unknown project"]}
    if shares_root(projects, project_id):
        return rest, {"deleted": {}, "warnings": ["root is shared; data kept"]}
    return rest, cleaned_up(store, row["project_root"])


def without_meta(vectors: DataFrame, field: str, value: str, meta: str = "meta") -> DataFrame:
    """Vectors but those whose JSON metadata has the value."""
    return vectors.where(~F.get_json_object(meta, f"$.{field}").eqNullSafe(F.lit(value)))


# --- sessions and runs ------------------------------------------------------


def appended(history: Column, item: Column) -> Column:
    """A history with an item at its end, each item once."""
    clean = F.filter(F.coalesce(history, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.coalesce(item, F.lit("")) == "", F.array_distinct(clean)).otherwise(F.array_distinct(F.concat(clean, F.array(item))))


def requirement_ids(values: Column, csv: Column) -> Column:
    """Repeated flags and a comma list, trimmed, each id once."""
    every = F.concat(F.coalesce(values, F.array().cast("array<string>")), F.split(F.coalesce(csv, F.lit("")), ","))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))


def target_choice(*choices: Column) -> Column:
    """The first choice that names a target: request, session, rerank, plan."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices])


def resolved_target(requested: Column, selected: Column, recommended: Column) -> Column:
    """(target, source): the request's target, the session's selected one or
    its recommended one; without any ``error`` says so."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    choices = [(F.nullif(requested, F.lit("")), "request"), (blank(selected), "session_selected"), (blank(recommended), "session_recommended")]
    target, source = F.coalesce(*[c for c, _ in choices]), F.coalesce(*[F.when(c.isNotNull(), s) for c, s in choices])
    return F.struct(target.alias("target"), source.alias("source"), F.when(target.isNull(), "no target given and none recommended").alias("error"))


def selected_targets(sessions: DataFrame, choices: DataFrame) -> DataFrame:
    """Sessions after a user's choice (session_id, target, operation, scope):
    its target, operation and scope where given, the status, and whether it
    differs from what was selected or else recommended. A request too thin
    still needs a decision (``thin``)."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = sessions.join(choices, "session_id")
    before = F.coalesce(blank("selected_target"), blank("recommended_target"))
    status = F.when(F.coalesce("thin", F.lit(False)), "needs_user_decision").otherwise("target_selected")
    return rows.select(
        "session_id", F.col("target").alias("selected_target"), F.coalesce(F.nullif("operation", F.lit("")), "requested_operation").alias("requested_operation"),
        F.coalesce(decisions.insert_scope(F.col("scope")), F.col("insert_scope")).alias("insert_scope"), status.alias("status"), (~blank("target").eqNullSafe(before)).alias("selection_changed"),
    )


def reclassified(reports: DataFrame) -> DataFrame:
    """Reports (run_id, verdict, generated_only, paths) in which only
    generated tests failed: their verdict, flags and files say so; others
    stay as they are."""
    only = F.coalesce("generated_only", F.lit(False))
    none = F.array().cast("array<string>")
    return reports.select(
        "run_id", F.when(only, "generated_test_verification_failed").otherwise(F.col("verdict")).alias("verdict"), (~only & (F.col("verdict") == "verification_failed")).alias("production_failed"),
        (only | (F.col("verdict") == "generated_test_verification_failed")).alias("generated_test_failed"), only.alias("runtime_only"), F.when(only, F.col("paths")).otherwise(none).alias("excluded_files"),
    )


def has_code(codes: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.coalesce(codes, F.array().cast("array<string>")), F.array(*[F.lit(w) for w in wanted]))


def insufficient(quality: Column, operation: Column, hints: Column) -> Column:
    """A request too thin to rerank: judged insufficient, no operation, no
    hint."""
    return (quality == "insufficient") & (F.coalesce(operation, F.lit("")) == "") & (F.coalesce(F.size(hints), F.lit(0)) == 0)


def import_change_candidate(payloads: DataFrame, by: list[str]) -> DataFrame:
    """The first payload (``pos``) that is a change of imports and sure."""
    rows = payloads.where((F.col("change_kind") == "import_change") & (F.col("confidence") >= decisions.SURE_IMPORT))
    return top_per_key(rows, by, [F.col("pos")], 1, "_r").drop("_r")


def generated_only_failure(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Whether the only failed blocks are those of generated tests."""
    bad = ~F.coalesce("ok", F.lit(False))
    return blocks.groupBy(*by).agg((F.count_if(bad & (F.col("block") == "generated_test")) > 0).alias("_t"), (F.count_if(bad & (F.col("block") != "generated_test")) == 0).alias("_o")).select(*by, (F.col("_t") & F.col("_o")).alias("generated_only"))


def checks_to_blocks(checks: DataFrame) -> DataFrame:
    """Raw checks (run_id, name, ok, output) as blocks with an issue each
    where they failed."""
    block = F.when(F.contains("name", F.lit("generated_test")), "generated_test").otherwise("production")
    code = F.when(~F.coalesce("ok", F.lit(False)), F.concat(F.col("name"), F.lit("_failed")))
    return checks.select("run_id", block.alias("block"), F.coalesce("ok", F.lit(False)).alias("ok"), code.alias("code"), decisions.failure_excerpt(F.col("output")).alias("message"))


def generated_test_path(path: Column) -> Column:
    return path.rlike(r"^tests/(.*/)?test_generated_[^/]*\.py$")


# --- candidate cards --------------------------------------------------------


def cards(candidates: DataFrame, symbols: DataFrame, relations: DataFrame, keep: int, siblings: int = 8, source_chars: int = 1200) -> DataFrame:
    """The first candidates (qualname, pos) with their symbol, its members or
    siblings and its edges; candidates without a symbol keep a bare card."""
    first = candidates.orderBy("pos").limit(keep)
    own = symbols.select("qualname", "name", "kind", "parent_qualname", "docstring", F.substring("source_code", 1, source_chars).alias("source_code"))
    rows = first.join(own, "qualname", "left")
    wanted = rows.select("qualname", F.when(F.col("kind") == "class", F.col("qualname")).otherwise(F.col("parent_qualname")).alias("_p"))
    near = symbols.where("kind = 'method'").select(F.col("parent_qualname").alias("_p"), F.col("name").alias("_n"), F.col("qualname").alias("_q"), "start_line").join(wanted, "_p").where("_q <> qualname")
    near = top_per_key(near, ["qualname"], [F.col("start_line")], siblings).groupBy("qualname").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_n"))), lambda x: x["_n"]).alias("members"))
    edges = relations.where("relation_kind <> 'contains'").join(first.select(F.col("qualname").alias("source_qualname")), "source_qualname", "left_semi")
    edges = edges.groupBy(F.col("source_qualname").alias("qualname")).agg(F.array_sort(F.collect_set(F.coalesce("target_qualname", "target_ref"))).alias("calls"))
    out = rows.join(near, "qualname", "left").join(edges, "qualname", "left")
    return out.withColumn("id", F.concat(F.lit("c"), F.row_number().over(Window.orderBy("pos"))))  # at most ``keep`` rows


def card_text(knowledge_title: Column | None = None) -> Column:
    """What a card's source, texts, members and calls say, in lower case."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source_code", "docstring")]
    parts += [F.coalesce(knowledge_title, F.lit(""))] if knowledge_title is not None else []
    lists = [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "\n") for c in ("members", "calls")]
    return F.lower(F.concat_ws("\n", *parts, *lists))


def ui_source(text: Column) -> Column:
    return decisions.any_of(text, UI_SOURCE)


def card_priority(request: str, queries: list[str], preferred: list[str]) -> Column:
    """Points of a card for a request: preferred names, planned queries in its
    identity or text, user-interface patterns, names in the request."""
    text, low = card_text(), request.lower()
    name, qual = F.lower(F.coalesce("name", F.element_at(F.split("qualname", r"\."), -1))), F.lower("qualname")
    identity = F.concat_ws("\n", qual, name, F.lower(F.coalesce("parent_qualname", F.lit(""))))
    ui = any(p in low for p in decisions.UI_ACTIONS)
    score = F.when(F.col("qualname").isin(preferred) if preferred else F.lit(False), CARD_POINTS["preferred"]).otherwise(0)
    for q in filter(None, (q.lower().strip() for q in queries)):
        score = score + F.when(F.contains(identity, F.lit(q)), CARD_POINTS["query"]).when(F.contains(text, F.lit(q)), CARD_POINTS["query_in_source"]).otherwise(0)
    if ui:
        part = lambda c, parts: reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])
        score = score + F.when(ui_source(text), CARD_POINTS["ui_source"]).otherwise(0)
        score = score + F.when((F.col("kind") == "method") & part(name, UI_SETUP), CARD_POINTS["ui_name"]).otherwise(0)
    word = F.regexp_like(F.lit(low), F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), F.regexp_replace(name, r"([\\.^$|?*+()\[\]{}])", r"\\$1"), F.lit(r"($|[^\p{L}\p{N}_])")))
    return score + F.when((qual != "") & F.contains(F.lit(low), qual), CARD_POINTS["qualname_in_request"]).when((name != "") & word, CARD_POINTS["name_in_request"]).otherwise(0)


def prioritised(cards_: DataFrame, priority: Column) -> DataFrame:
    """Cards by priority, their own order on ties and where none has any."""
    return cards_.withColumn("priority", priority).orderBy(F.desc("priority"), "pos")


def mapped_ids(ranked: DataFrame, cards_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked card ids as candidates, and the ids that no card has."""
    known = cards_.select("id", "qualname")
    return ranked.join(known, "id").select("id", "rank", "qualname"), ranked.join(known, "id", "left_anti")


def mentioned(cards_: DataFrame, names: list[str]) -> DataFrame:
    """Cards whose name or qualname the request names outright."""
    return cards_.where(F.col("name").isin(names) | F.col("qualname").isin(names)) if names else cards_.limit(0)


# --- knowledge payloads and flows -------------------------------------------


def module_tables(symbols: DataFrame) -> list[tuple[str, DataFrame]]:
    """Ways to name a module, in the order they are tried: itself, its file,
    its file as a module, its last segment where that is unambiguous."""
    modules = symbols.where("kind = 'module'").select("file_path", F.col("qualname").alias("module")).distinct()
    table = lambda ref: modules.select(ref.alias("ref"), F.col("module").alias("target")).groupBy("ref").agg(F.min("target").alias("target"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return [
        ("module", table(F.col("module"))), ("file", table(F.col("file_path"))), ("path", table(F.replace(F.col("file_path"), F.lit("/"), F.lit(".")))),
        ("tail", table(F.element_at(F.split("module", r"\."), -1))),
    ]


def module_refs(refs: DataFrame, symbols: DataFrame, column: str = "ref") -> DataFrame:
    return graph.cascade(refs, column, module_tables(symbols))


def flow_references(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """References of flow steps (step_id, step) with what they resolve to:
    symbol, alias or module; else ambiguous where several symbols end in it,
    similar where close names exist, or missing: (step_id, ref, target,
    reason, suggestions)."""
    refs = steps.select("step_id", F.explode(decisions.flow_references(F.col("step"))).alias("ref")).distinct()
    names = symbols.where("kind <> 'module'").select(F.col("qualname").alias("ref"), F.col("qualname").alias("target")).distinct()
    alias = graph.aliases(symbols.where("kind <> 'module'")).select(F.col("alias").alias("ref"), F.col("qualname").alias("target"))
    found = graph.cascade(refs, "ref", [("symbol", names), ("alias", alias), *module_tables(symbols)]).withColumnRenamed("step", "how")
    open_refs = found.where("target is null").select("ref").distinct()
    tails = symbols.select("qualname", F.split("qualname", r"\.").alias("_p"))
    tails = tails.select("qualname", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.array_join(F.slice("_p", F.size("_p") - n + 1, n), "."))).alias("ref"))
    several = top_per_key(open_refs.join(tails, "ref"), ["ref"], [F.col("qualname")], 5).groupBy("ref").agg(F.array_sort(F.collect_list("qualname")).alias("_several"))
    close = decisions.close_names(open_refs, symbols.where("kind <> 'module'").select(F.col("qualname").alias("name"))).groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))), lambda x: x.suggestion).alias("_close"))
    out = found.join(several, "ref", "left").join(close, "ref", "left")
    reason = F.when(F.col("target").isNotNull(), F.col("how")).when(F.col("_several").isNotNull(), "ambiguous").when(F.col("_close").isNotNull(), "similar").otherwise("missing")
    return out.select("step_id", "ref", "target", reason.alias("reason"), F.coalesce("_several", "_close").alias("suggestions"))


def merged_layers(existing: DataFrame, new: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers (layer, module) replaced by new ones, sorted and distinct, and
    the new rows whose module the index lacks."""
    good = new.join(known.select("module").distinct(), "module", "left_semi")
    kept = existing.join(new.select("layer").distinct(), "layer", "left_anti").unionByName(good.select(existing.columns))
    return kept.distinct().orderBy("layer", "module"), new.join(known.select("module").distinct(), "module", "left_anti")


def direct_children(symbols: DataFrame, parent: str) -> DataFrame:
    """Symbols one segment below the parent; constructors aside."""
    tail = F.substring("qualname", len(parent) + 2, 10_000)
    return symbols.where(F.col("qualname").startswith(parent + ".") & ~F.contains(tail, F.lit(".")) & (F.col("name") != "__init__"))


def inserted_symbols(rows: DataFrame) -> DataFrame:
    """What an insertion made: the changed symbols right below its parent
    (constructors aside where a method was wanted), else the first name in its
    code. ``rows``: run_id, changed, parent, target, kind, scope, file, code."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    above = F.when(F.contains(F.coalesce("target", F.lit("")), F.lit(".")), F.regexp_replace("target", r"\.[^.]+$", ""))
    parent = F.coalesce(blank("parent"), F.when(F.col("scope") == "class_body", blank("target")).otherwise(above))
    rows = rows.withColumn("_p", parent)
    below = F.filter(F.coalesce("changed", F.array().cast("array<string>")), lambda x: F.startswith(x, F.concat("_p", F.lit("."))) & ~F.contains(F.substring(x, F.length("_p") + 2, F.length(x)), F.lit(".")))
    below = F.when(F.col("_p").isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(below))
    methods = F.filter(below, lambda x: ~x.endswith(".__init__"))
    kept = F.when((F.col("kind") == "method") & (F.size(methods) > 0), methods).otherwise(below)
    first = F.nullif(F.regexp_extract(F.coalesce("code", F.lit("")), r"(?m)^(?:async def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)", 1), F.lit(""))
    module = F.when(F.col("file").endswith(".py"), F.replace(F.regexp_replace("file", r"\.py$", ""), F.lit("/"), F.lit("."))).otherwise(above)
    prefix = F.coalesce("_p", module)
    fallback = F.when(first.isNotNull(), F.array(F.when(prefix.isNull(), first).otherwise(F.concat(prefix, F.lit("."), first)))).otherwise(F.array().cast("array<string>"))
    return rows.select("run_id", F.when(F.size(kept) > 0, kept).otherwise(fallback).alias("symbols"))


def traced(symbols: DataFrame, known_symbols: DataFrame, known_modules: DataFrame) -> DataFrame:
    """Where changed symbols are recorded: themselves if curated, else their
    module, else the nearest curated module: (qualname, target, how)."""
    rows = symbols.select("qualname", "module_name")
    rows = rows.join(known_symbols.select("qualname", F.col("qualname").alias("_s")).distinct(), "qualname", "left").join(known_modules.select(F.col("module").alias("module_name"), F.col("module").alias("_m")).distinct(), "module_name", "left")
    rows = graph.longest_prefix(rows, "qualname", known_modules, "module")
    how = F.when(F.col("_s").isNotNull(), "symbol").when(F.col("_m").isNotNull(), "module").when(F.col("nearest").isNotNull(), "nearest_module")
    return rows.select("qualname", F.coalesce("_s", "_m", "nearest").alias("target"), how.alias("how"))


# --- the chat source --------------------------------------------------------


def chat_json(call: Callable[[str, str], str], system: str, user: str, most_chars: int | None = None) -> dict:
    """One model call whose reply is an object; a prompt over the budget is
    refused before the call, a reply beyond repair raises."""
    from ..sources.documents import recovered

    if most_chars is not None and len(system) + len(user) > most_chars:
        raise ValueError(f"prompt of {len(system) + len(user)} characters exceeds {most_chars}")
    found = recovered(call(system, user))
    if found is None:
        raise ValueError("the reply holds no object")
    return json.loads(found)
