"""What an analysis does with a search plan and a reranker's reply: which
target counts, what is returned, which warnings stay, and how an insertion
finds its anchor. Column functions and frames; the model's calls are the
caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import SURE_TARGET
from .search import top_per_key

# Codes, states and texts of an analysis.
MOST_RETURNED = 5
OPEN_STATES = ("uncertain", "unknown", "insufficient")
NEW_FILE_CODES = ("missing_stub_module", "unsupported_new_file_required")
KEPT_CODES = ("analysis_llm_rerank_invalid_json_contract", "analysis_llm_rerank_json_repaired", "analysis_llm_rerank_json_recovered")
RECOVERED_CODE = "analysis_llm_rerank_json_recovered"
NON_SYMBOL_CODE = "non_symbol_change_not_supported_for_auto_target"
SYMBOL_CATEGORY = "средняя"
RELATION_ROLES = {"imports": "imported_contract", "exposed_by_controller": "controller_or_endpoint_contract", "belongs_to_layer": "same_layer_contract"}
LAYERS = ("api", "services", "storage", "domain")
CONFIDENCE_ORDER, DIRECTION_ORDER = ("high", "medium", "low"), ("outbound", "inbound")
RELATION_ORDER = ("calls", "exposed_by_controller", "imports", "belongs_to_layer")

_strings = "array<string>"


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_strings))


def any_code(codes: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(_list(codes), F.array(*[F.lit(w) for w in wanted]))


# --- targets ------------------------------------------------------------------


def accepted(target: Column, sure: Column, review: Column, found: Column, least: float = SURE_TARGET) -> Column:
    """The recommended target where it is named, sure enough, needs no review
    and is among the candidates (``found``)."""
    name = F.nullif(F.trim(target), F.lit(""))
    return F.when(~_flag(review) & (F.coalesce(sure, F.lit(0.0)) >= least) & F.array_contains(_list(found), name), name)


def request_quality(status: Column, target: Column, sure: Column, review: Column, least: float = SURE_TARGET) -> Column:
    """An open state becomes processable where the rerank is sure of a target."""
    named = F.coalesce(F.trim(target), F.lit("")) != ""
    settled = F.lower(F.trim(status)).isin(*OPEN_STATES) & ~_flag(review) & named & (F.coalesce(sure, F.lit(0.0)) >= least)
    return F.when(_flag(settled), "processable").otherwise(status)


def review_required(reranked: Column, plan_review: Column, rerank_review: Column, codes: Column, accepted_target: Column, target: Column) -> Column:
    """Without a rerank the plan's flag or no target; with one its flag, a
    need for a new file, or no accepted target."""
    with_rerank = _flag(rerank_review) | any_code(codes, NEW_FILE_CODES) | accepted_target.isNull()
    return F.when(_flag(reranked), with_rerank).otherwise(_flag(plan_review) | target.isNull())


def new_file_marked(codes: Column) -> Column:
    """Warning codes with the one on new files, where a stub's module is
    missing; such an analysis needs review."""
    return F.when(any_code(codes, NEW_FILE_CODES[:1]), F.array_union(_list(codes), F.array(F.lit(NEW_FILE_CODES[1])))).otherwise(_list(codes))


def kept_warnings(codes: Column, review: Column, target: Column, sure: Column, least: float = SURE_TARGET) -> Column:
    """Where the target is settled, only failures of calls and the codes on
    broken replies stay."""
    settled = ~_flag(review) & target.isNotNull() & (F.coalesce(sure, F.lit(0.0)) >= least)
    failures = F.filter(_list(codes), lambda c: (c.startswith("analysis_llm_") & c.endswith("_failed")) | c.isin(*KEPT_CODES))
    return F.when(_flag(settled), failures).otherwise(_list(codes))


def non_symbol_change(review: Column, target: Column, sure: Column, codes: Column, import_change: Column) -> Column:
    """A change of imports has no target of its own: none is kept, and it
    needs review."""
    yes = _flag(import_change)
    return F.struct(
        (_flag(review) | yes).alias("review"), F.when(~yes, target).alias("target"), F.when(yes, 0.0).otherwise(sure).alias("sure"), F.when(yes, "import_change").alias("role"),
        F.when(yes, F.concat(_list(codes), F.array(F.lit(NON_SYMBOL_CODE)))).otherwise(_list(codes)).alias("codes"), F.when(yes, target).alias("previous_target"),
    )


def symbol_candidate(score: Column) -> Column:
    """(score, confidence, category) of a symbol that is a candidate without a search."""
    return F.struct(score.alias("score"), F.least(F.lit(1.0), score / 10.0).alias("confidence"), F.lit(SYMBOL_CATEGORY).alias("category"))


def returned_candidates(candidates: DataFrame, by: list[str], recommended: str = "recommended", most: int = MOST_RETURNED) -> DataFrame:
    """What the caller gets, with ``rank``: the reranker's candidates by their
    rank, or where it ranked none the recommended one first and the others in
    their order. ``candidates``: by, qualname, pos, confidence, llm_rank and
    the recommended target's column."""
    any_ranked = candidates.where("llm_rank is not null").select(*by).distinct().withColumn("_any", F.lit(True))
    rows = candidates.join(any_ranked, by, "left").where(F.col("_any").isNull() | F.col("llm_rank").isNotNull())
    order = [F.col("llm_rank").asc_nulls_last(), F.when(F.col("_any"), -F.col("confidence")), F.when(F.col("_any"), F.col("qualname"))]
    order += [F.when(F.col("qualname") == F.col(recommended), 0).otherwise(1), F.col("pos")]
    return top_per_key(rows, by, order, most).drop("_any")


def ranked_items(ranked: Column, recommended: Column, alternatives: Column, most: int = MOST_RETURNED) -> Column:
    """Ids a reply ranks; without any, its recommendation and alternatives,
    each once."""
    clean = lambda c: F.filter(F.transform(_list(c), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    fallback = F.array_distinct(clean(F.concat(F.array(recommended), _list(alternatives))))
    return F.slice(F.when(F.size(clean(ranked)) > 0, clean(ranked)).otherwise(fallback), 1, most)


def exact_matches(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per request its candidates named outright, and the fallback: the only
    match, where an operation replaces and no target was recommended. Such a
    fallback is not confirmed. ``candidates``: by, qualname, pos, named,
    operation, recommended."""
    seen = candidates.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("named"), F.struct("pos", "qualname")))).alias("_m"), F.max("operation").alias("_op"), F.max("recommended").alias("_rec")
    )
    matches = F.transform("_m", lambda x: x.qualname)
    fallback = F.when((F.size("_m") == 1) & (F.col("_op") == "replace_symbol") & F.col("_rec").isNull(), F.get(matches, 0))
    return seen.select(*by, matches.alias("matches"), fallback.alias("fallback"))


# --- anchors ------------------------------------------------------------------


def last_anchors(symbols: DataFrame) -> DataFrame:
    """The last class or function of each file's top level, by its end, start
    and name: (file_path, anchor, anchor_kind). Where a file has no module
    symbol, all its classes and functions count."""
    modules = symbols.where("kind = 'module'").groupBy("file_path").agg(F.min("qualname").alias("_m"))
    tops = symbols.where("kind in ('class', 'function')").join(modules, "file_path", "left").where("_m is null or parent_qualname = _m")
    best = F.max_by(F.struct("qualname", "kind"), F.struct("end_line", "start_line", "qualname"))
    return tops.groupBy("file_path").agg(best.alias("_b")).select("file_path", F.col("_b.qualname").alias("anchor"), F.col("_b.kind").alias("anchor_kind"))


def anchored(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``final_target``, ``role`` and ``scope``: an insertion that is not
    into a class body goes after the last top-level symbol of the target's
    file; a method whose class becomes the anchor makes it an insertion into
    that class. ``requests``: operation, insert_scope, target."""
    own = symbols.select(F.col("qualname").alias("_q"), F.col("kind").alias("_kind"), "file_path")
    rows = requests.join(own, F.col("target") == F.col("_q"), "left").join(last_anchors(symbols), "file_path", "left")
    inside = (F.col("insert_scope") == "class_body") & F.col("_kind").isin("class", "method")
    moved = _flag((F.col("operation") == "insert_after_symbol") & ~_flag(inside) & F.col("anchor").isNotNull() & (F.col("anchor") != F.col("target")))
    parent = moved & (F.col("_kind") == "method") & (F.col("anchor_kind") == "class") & (F.col("insert_scope").isNull() | (F.col("insert_scope") == "module_body"))
    return rows.select(
        *requests.columns, F.when(moved, F.col("anchor")).otherwise(F.col("target")).alias("final_target"),
        F.when(parent, "parent_class").when(moved, "anchor").otherwise("target").alias("role"), F.when(parent, "class_body").otherwise(F.col("insert_scope")).alias("scope"),
    )


# --- replies ------------------------------------------------------------------


def reply_field(raw: Column, key: str) -> Column:
    """The first string value of a key in a text that need not be JSON."""
    found = F.regexp_extract(raw, rf'"{key}"\s*:\s*"([^"\\]*(?:\\.[^"\\]*)*)"', 1)
    return F.when(raw.rlike(rf'"{key}"\s*:\s*"'), F.replace(F.replace(F.replace(found, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))


def reply_number(raw: Column, key: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(raw, rf'"{key}"\s*:\s*(-?\d+(?:\.\d+)?)', 1), F.lit("")).cast("double"), F.lit(0.0))


def recovered_reranks(replies: DataFrame, cards: DataFrame) -> DataFrame:
    """Fields of rerank replies (reply_id, raw) that no JSON parser takes:
    ranked ids that have a card (reply_id, candidate_id, qualname), the
    recommended target, operation and scope. Each needs review; a reply with
    neither a target nor a known id has no row."""
    known = cards.groupBy("reply_id").agg(F.map_from_entries(F.collect_list(F.struct("candidate_id", "qualname"))).alias("_cards"))
    rows = replies.join(known, "reply_id", "left").withColumn("_cards", F.coalesce("_cards", F.create_map().cast("map<string,string>")))
    raw = F.col("raw")
    ids = F.regexp_extract_all(raw, F.lit(r'"candidate_id"\s*:\s*"([^"]+)"'), F.lit(1))
    rows = rows.withColumn("_rec", reply_field(raw, "recommended_candidate_id"))
    listed = F.filter(F.array_distinct(F.array_compact(F.concat(F.array("_rec"), ids))), lambda x: F.map_contains_key(F.col("_cards"), x))
    rows = rows.withColumn("ranked", F.slice(listed, 1, MOST_RETURNED))
    target = F.coalesce(F.nullif(reply_field(raw, "recommended_target"), F.lit("")), F.element_at("_cards", F.when(F.map_contains_key("_cards", F.coalesce("_rec", F.lit(""))), F.col("_rec")).otherwise(F.get("ranked", 0))))
    rows = rows.withColumn("recommended_target", target).where("recommended_target is not null or size(ranked) > 0")
    either = lambda *keys: F.coalesce(*[reply_field(raw, k) for k in keys], F.lit("unknown"))
    return rows.select(
        "reply_id", "ranked", "recommended_target", either("recommended_operation", "operation").alias("operation"), either("value").alias("insert_scope"), either("target_role").alias("target_role"),
        reply_number(raw, "target_confidence").alias("target_confidence"), F.lit(True).alias("manual_review_required"), F.lit(RECOVERED_CODE).alias("code"),
    )


def reply_diagnostics(replies: DataFrame, cards: DataFrame, preview: int = 400) -> DataFrame:
    """Counts and previews of parsed replies (reply_id, raw, ranked,
    recommended_candidate_id, recovered) against their cards."""
    known = cards.groupBy("reply_id").agg(F.count("*").alias("cards"), F.array_sort(F.collect_set("candidate_id")).alias("_ids"))
    rows = replies.join(known, "reply_id", "left").withColumn("_ids", _list(F.col("_ids")))
    return rows.select(
        "reply_id", F.coalesce("cards", F.lit(0)).alias("cards"), F.length("raw").alias("raw_chars"), F.substring("raw", 1, preview).alias("raw_preview"), (~_flag(F.col("recovered"))).alias("strict"),
        F.size(_list(F.col("ranked"))).alias("ranked"), F.array_except(_list(F.col("ranked")), F.col("_ids")).alias("unknown_ids"), F.array_contains("_ids", F.coalesce("recommended_candidate_id", F.lit(""))).alias("recommended_known"),
    )


def prompt_diagnostics(original: DataFrame, included: DataFrame, by: list[str]) -> DataFrame:
    """Cards (by, candidate_id, pos) before and after a prompt was cut: their
    counts and the ids that were dropped, in order."""
    kept = included.select(*by, "candidate_id").distinct().withColumn("_in", F.lit(True))
    rows = original.join(kept, [*by, "candidate_id"], "left").groupBy(*by).agg(
        F.count("*").alias("original_count"), F.count("_in").alias("included_count"), F.array_sort(F.collect_list(F.when(F.col("_in").isNull(), F.struct("pos", "candidate_id")))).alias("_d")
    )
    return rows.select(*by, "original_count", "included_count", F.size("_d").alias("dropped_count"), F.transform("_d", lambda x: x.candidate_id).alias("dropped"))


# --- payloads -----------------------------------------------------------------


def requirement(title: Column, description: Column, constraints: Column, external_id: Column, priority: Column) -> Column:
    """One requirement: trimmed texts, constraints without blanks, optional
    keys null where blank."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    lines = F.filter(F.transform(_list(constraints), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.struct(text(title).alias("title"), text(description).alias("description"), lines.alias("constraints"), F.nullif(external_id, F.lit("")).alias("external_requirement_id"), F.nullif(priority, F.lit("")).alias("priority"))


PLAN = (
    "request_quality struct<status:string,missing_information:array<string>>, change_kind struct<value:string,confidence:double>, operation struct<value:string,confidence:double>, insert_scope struct<value:string,confidence:double>, "
    "expected_new_symbols array<string>, search_plan struct<search_queries:array<string>,preferred_files:array<string>,preferred_qualnames:array<string>,preferred_layers:array<string>,avoid_layers:array<string>>, "
    "multi_target_likely boolean, manual_review_required boolean"
)


def compact_plan(plan: Column, queries: int = 8) -> Column:
    """The parts of a search plan (JSON) that a prompt needs, missing lists
    empty and the queries limited."""
    p = F.from_json(plan, PLAN)
    lists = {k: _list(p.search_plan[k]) for k in ("search_queries", "preferred_files", "preferred_qualnames", "preferred_layers", "avoid_layers")}
    lists["search_queries"] = F.slice(lists["search_queries"], 1, queries)
    quality = F.struct(p.request_quality.status.alias("status"), _list(p.request_quality.missing_information).alias("missing_information"))
    return F.struct(
        quality.alias("request_quality"), p.change_kind.alias("change_kind"), p.operation.alias("operation"), p.insert_scope.alias("insert_scope"), _list(p.expected_new_symbols).alias("expected_new_symbols"),
        F.struct(*[c.alias(k) for k, c in lists.items()]).alias("search_plan"), _flag(p.multi_target_likely).alias("multi_target_likely"), _flag(p.manual_review_required).alias("manual_review_required"),
    )


def summaries(analyses: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """One row per analysis (by, review, recommended_target, ...): its status,
    how many candidates there are and the first three."""
    top = candidates.groupBy(*by).agg(F.count("*").alias("candidates_count"))
    first = top_per_key(candidates.select(*by, "qualname", "pos"), by, [F.col("pos")], 3).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "qualname"))), lambda x: x.qualname).alias("top_candidates"))
    rows = analyses.join(top, by, "left").join(first, by, "left")
    return rows.withColumn("status", F.when(_flag(F.col("review")), "needs_user_decision").otherwise("analyzed")).na.fill(0, ["candidates_count"]).withColumn("top_candidates", _list(F.col("top_candidates")))


def context_summary(pack: DataFrame) -> DataFrame:
    """Counts of what ``graph.context_pack`` gathered for each target."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"{c}_count")
    return pack.select("qualname", "name", "kind", *[n(c) for c in ("neighbors", "inbound", "outbound", "tests", "related")])


def annotations(title: Column, description: Column, requirements: Column) -> Column:
    """Notes on a symbol: its title, its description and a line for each
    requirement (id, title); blanks dropped."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    notes = F.array(F.when(~blank(title), F.concat(F.lit("Knowledge title: "), title)), F.when(~blank(description), description))
    return F.array_compact(F.concat(notes, F.transform(requirements, lambda r: F.concat(F.lit("Связано с требованием "), r.id, F.lit(": "), r.title))))


def has_tests(tests: Column, target: Column) -> Column:
    """Whether one of the test rows (qualname, file_path, reasons) names the
    target or its last segment."""
    full, name = F.lower(target), F.lower(F.element_at(F.split(target, r"\."), -1))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hit = lambda t: F.contains(low(t.qualname), full) | ((name != "") & (F.contains(low(t.qualname), name) | F.contains(low(t.file_path), name) | F.exists(_list(t.reasons), lambda r: F.contains(F.lower(r), name))))
    return _flag(F.exists(tests, hit))


# --- related symbols ----------------------------------------------------------


def layer_of(module: Column) -> Column:
    """The first of the layers that is a segment of the module's name."""
    parts = F.split(module, r"\.")
    return F.coalesce(*[F.when(F.array_contains(parts, x), x) for x in LAYERS])


def relation_role(kind: Column, direction: Column, origin: Column, target: Column) -> Column:
    """What an edge makes of a related symbol; ``origin`` is the end that
    belongs to the target, one of its members where it is another symbol."""
    child, out = origin != target, direction == "outbound"
    calls = F.when(out & child, "called_by_class_member").when(out, "called_by_target").when(child, "caller_of_class_member").otherwise("caller_of_target")
    fixed = F.coalesce(*[F.when(kind == k, v) for k, v in RELATION_ROLES.items()])
    return F.when((kind == "calls") & direction.isin(*DIRECTION_ORDER), calls).otherwise(F.coalesce(fixed, F.concat_ws("_", direction, kind)))


def _place(c: str, order: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.col(c) == x, i) for i, x in enumerate(order)], F.lit(9))


def selected_related(related: DataFrame, by: list[str], limit: int, source_chars: int) -> DataFrame:
    """The first related symbols of each target by confidence, direction,
    kind, file, origin and name, their source cut to ``source_chars`` with
    ``truncated``, and ``total_chars`` up to each."""
    from ..functions.text import truncated_source

    order = [_place("relation_confidence", CONFIDENCE_ORDER), _place("relation_direction", DIRECTION_ORDER), _place("relation_kind", RELATION_ORDER), F.col("file_path"), F.col("origin_qualname"), F.col("qualname")]
    rows = top_per_key(related, by, order, max(0, limit))
    cut = rows.withColumn("truncated", (F.length(F.coalesce("source_code", F.lit(""))) > source_chars) & F.lit(source_chars > 0)).withColumn("source_excerpt", truncated_source(F.coalesce("source_code", F.lit("")), source_chars))
    keys = ", ".join(f"`{c}`" for c in by)
    return cut.drop("source_code").withColumn("total_chars", F.expr(f"sum(length(source_excerpt)) over (partition by {keys} order by rank)"))


RELATED_FIELDS = ("qualname", "file_path", "module_name", "name", "kind", "role", "origin_qualname", "relation_kind", "relation_direction", "relation_source", "relation_confidence", "signature", "docstring")


def related_payload(rows: DataFrame) -> DataFrame:
    """The sixteen canonical columns of a related symbol; what is missing is
    an empty text, a missing parent stays null."""
    has = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string") if c in has else F.lit(None).cast("string"), F.lit(""))
    sources = [F.nullif(text(c), F.lit("")) for c in ("source_excerpt", "source_code", "source")]
    parent = F.col("parent_qualname") if "parent_qualname" in has else F.lit(None).cast("string")
    cut = _flag(F.col("truncated")) if "truncated" in has else F.lit(False)
    return rows.select(*[text(c).alias(c) for c in RELATED_FIELDS], parent.alias("parent_qualname"), F.coalesce(*sources, F.lit("")).alias("source_excerpt"), cut.alias("truncated"))
