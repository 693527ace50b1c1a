"""Request classifiers and decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .suggest import close_names

__all__ = ["close_names"]

# Texts the classifiers look for, in lower case.
PROTECTIVE = (
    "не менять", "не изменять", "не трогать", "не реализовывать", "не подключать", "не добавлять", "не создавать", "не дублировать", "не удалять",
    "сохранить ", "оставить ", "do not change", "do not modify", "do not touch", "keep ", "preserve ",
)
IMPORTS = ("import", "импорт")
CHANGES = ("измен", "замен", "исправ", "удал", "добав", "change", "replace", "fix", "remove", "add")
DEPENDENCIES = ("зависим", "компонент", "библиотек", "пакет", "dependency", "component", "library", "package")
CONNECTIONS = ("подключ", "распозна", "не найден", "не найдена", "недоступ", "установлен", "installed", "not found", "unavailable", "detect")
REPAIRS = ("исправ", "почин", "fix", "repair")
IMPLEMENT = ("реализ", "дореализ", "заполн", "убрать заглуш", "заменить заглуш", "добавить реализац", "нужно реализ")
STUBS = ("notimplementederror", "todo: реализ", "todo реализ", "метод требует реализации", "требует реализации")
UI_ACTIONS = ("панел", "инструмент", "кнопк", "toolbar", "tool bar", "action", "button", "меню", "окн", "ui", "интерфейс")
MEANINGLESS = (
    "и", "или", "в", "во", "на", "по", "для", "из", "с", "со", "к", "как", "что", "это",
    "the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "by", "with",
    "реализовать", "реализует", "реализация", "добавить", "создать", "метод", "функция",
    "должен", "должна", "должно", "нужно", "требуется", "полный", "полного",
)
SUMMARY_TOPIC = (("стат", "summary", "summar", "свод", "отчет", "отчёт", "report"), ("stat", "stats", "statistics", "summary", "summar", "report"))
TICKET_TOPIC = (("тикет", "ticket"), ("ticket",))
REUSE = ("использ", "переиспольз", "reuse", "use existing", "existing")
EXISTING = ("существ", "сервис", "service", "контракт", "contract", "функц", "helper")
NO_DUPLICATES = ("не дублир", "не копир", "не повтор", "do not duplicate", "without duplicating")
STUB_BLOCKERS = ("missing_stub_module", "unsupported_new_file_required")
LEAST_RELEVANCE = 0.12
SCOPES = ("module_body", "class_body")
KINDS = ("class", "function", "method")
SURE_TARGET = 0.65
SURE_IMPORT = 0.6


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p.lower()))
    return out


def protective(c: Column) -> Column:
    """A constraint that guards what exists: it begins, bullets aside, with
    one of the fixed openings."""
    bare = F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\-–—•]+", "")))
    out = F.lit(False)
    for p in PROTECTIVE:
        out = out | bare.startswith(p)
    return out


def named_symbols(c: Column) -> Column:
    """Identifiers with an underscore or a dot in texts that are no guards,
    with their last segments; dunders aside."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"), F.lit(1))
    dunder = r"^__.*__$"
    names = F.filter(found, lambda n: (F.contains(n, F.lit("_")) | F.contains(n, F.lit("."))) & ~n.rlike(dunder))
    tails = F.filter(F.transform(names, lambda n: F.element_at(F.split(n, r"\."), -1)), lambda n: ~n.rlike(dunder))
    return F.when(protective(c), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_union(names, tails)))


def import_change(c: Column) -> Column:
    """About imports and a change of them, or about a dependency, its
    connection and a repair."""
    return (any_of(c, IMPORTS) & any_of(c, CHANGES)) | (any_of(c, DEPENDENCIES) & any_of(c, CONNECTIONS) & any_of(c, REPAIRS))


def implementation(c: Column) -> Column:
    return any_of(c, IMPLEMENT)


def ui_action(c: Column) -> Column:
    return any_of(c, UI_ACTIONS)


def stub(source: Column) -> Column:
    return any_of(source, STUBS)


def topics(c: Column) -> Column:
    """Tokens of the two topics that a request may be about."""
    none = F.array().cast("array<string>")
    each = [F.when(any_of(c, stems), F.array(*[F.lit(t) for t in tokens])).otherwise(none) for stems, tokens in (SUMMARY_TOPIC, TICKET_TOPIC)]
    return F.array_sort(F.array_union(*each))


def reuse(c: Column) -> Column:
    """(reuse and something that exists) or avoid duplicates."""
    return (any_of(c, REUSE) & any_of(c, EXISTING)) | any_of(c, NO_DUPLICATES)


def first_valid(allowed: tuple[str, ...], *choices: Column) -> Column:
    """The first choice that is one of the allowed values."""
    return F.coalesce(*[F.when(c.isin(*allowed), c) for c in choices])


def insert_scope(*choices: Column) -> Column:
    return first_valid(SCOPES, *choices)


def expected_kind(*choices: Column) -> Column:
    """The first valid kind; a property is a method."""
    return first_valid(KINDS, *[F.when(c == "property", F.lit("method")).otherwise(c) for c in choices])


def accepted_target(target: Column, sure: Column, least: float = SURE_TARGET) -> Column:
    """The recommended target, if it is named and sure enough."""
    return F.when((F.trim(F.coalesce(target, F.lit(""))) != "") & (F.coalesce(sure, F.lit(0.0)) >= least), target)


def manual_review(reranked: Column, plan_flag: Column, rerank_flag: Column, target: Column, codes: Column, blocking: tuple[str, ...]) -> Column:
    """Without a rerank: the plan's flag or no target. With one: its flag, a
    blocking warning, or no accepted target."""
    blocked = F.arrays_overlap(F.coalesce(codes, F.array().cast("array<string>")), F.array(*[F.lit(b) for b in blocking])) if blocking else F.lit(False)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.when(flag(reranked), flag(rerank_flag) | blocked | target.isNull()).otherwise(flag(plan_flag) | target.isNull())


def generation_block(operation: Column, anchor_kind: Column, scope: Column) -> Column:
    """Why an insertion after a method cannot be generated: ambiguous without
    a scope, unsafe into the module; null where it can."""
    after_method = (operation == "insert_after_symbol") & (anchor_kind == "method")
    return F.when(after_method & scope.isNull(), "ambiguous_insert_scope").when(after_method & (scope == "module_body"), "unsafe_module_insert_after_method")


def member_insert(operation: Column, anchor_kind: Column, kind: Column, text: Column) -> Column:
    """An additive request for a method of a class that came as the class's
    replacement is an insertion into its body."""
    additive = any_of(text, ("add", "new", "добав", "нов"))
    return F.when((operation == "replace_symbol") & (anchor_kind == "class") & (kind == "method") & additive, "insert_after_symbol").otherwise(operation)


def repair_gate(blocks: DataFrame, by: list[str]) -> DataFrame:
    """accepted where no block failed."""
    failed = F.count_if(~F.coalesce("ok", F.lit(False)))
    return blocks.groupBy(*by).agg(failed.alias("failed")).withColumn("gate", F.when(F.col("failed") == 0, "accepted").otherwise("rejected"))


def merge_plan(reports: DataFrame) -> DataFrame:
    """What may be merged: ``verdict`` ready and some file changed."""
    ready = (F.col("verdict") == "ready_for_merge_review") & (F.size("changed_files") > 0)
    return reports.withColumn("merge_status", F.when(ready, "ready").when(F.size("changed_files") == 0, "nothing_to_merge").otherwise("blocked"))


def meaningful(c: Column) -> Column:
    """Distinct words of three letters or more, the fixed ones aside."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([A-Za-zА-Яа-яЁё0-9_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*MEANINGLESS)))


def stub_relevance(query: Column, *texts: Column) -> Column:
    """Overlap of the meaningful words of a request and of a candidate's
    texts: name, qualname, docstring, knowledge title and symbol docstring."""
    from .knowledge import overlap

    return overlap(meaningful(query), meaningful(F.concat_ws(" ", *texts)))


def best_stub(candidates: DataFrame, by: list[str], least: float = LEAST_RELEVANCE) -> DataFrame:
    """The stub of the highest relevance + score / 100 + confidence / 10, the
    first on ties (``pos``), among those relevant enough. ``candidates`` with
    a column ``kind`` give functions and methods only."""
    total = F.col("relevance") + F.greatest(F.col("score"), F.lit(0.0)) / 100 + F.greatest(F.col("confidence"), F.lit(0.0)) / 10
    rows = candidates.where(F.col("is_stub") & (F.col("relevance") >= least))
    if "kind" in candidates.columns:
        rows = rows.where(F.col("kind").isin("method", "function"))
    return rows.groupBy(*by).agg(F.max_by("qualname", F.struct(total, -F.col("pos"))).alias("qualname"))


def stub_kept(operation: Column, recommended_operation: Column, review: Column, codes: Column, query: Column, kind: Column, is_stub: Column, relevance: Column) -> Column:
    """Whether a recommended replacement of a stub stands over an insertion
    that was asked for."""
    blocked = F.arrays_overlap(F.coalesce(codes, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in STUB_BLOCKERS]))
    rule = (operation == "insert_after_symbol") & ~F.coalesce(review, F.lit(False)) & ~blocked & implementation(query) & (recommended_operation == "replace_symbol")
    return F.coalesce(rule & kind.isin("method", "function") & is_stub & (relevance >= LEAST_RELEVANCE), F.lit(False))


def failed_paths(output: Column) -> Column:
    """Paths that a test run's output names as failed, in order, each once."""
    found = F.regexp_extract_all(F.coalesce(output, F.lit("")), F.lit(r"(?m)^(?:FAILED|ERROR)\s+(\S+?\.py)|File \"([^\"]+\.py)\""), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^(FAILED|ERROR)\s+", ""), r'^File "|"$', ""))
    return F.array_distinct(bare)


def failure_excerpt(output: Column, lines: int = 20, chars: int = 1600) -> Column:
    kept = F.slice(F.filter(F.split(F.coalesce(output, F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, lines)
    return F.substring(F.array_join(kept, "\n"), 1, chars)


def flow_references(step: Column) -> Column:
    """Backticked and dotted names of a flow step that look like code: not of
    self or cls, of three segments, a file, or with a capital root."""
    ticked = F.regexp_extract_all(step, F.lit("`([^`]+)`"), F.lit(1))
    loose = F.regexp_extract_all(step, F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"), F.lit(1))
    fit = lambda n: F.contains(n, F.lit(".")) & ~n.rlike(r"^(self|cls)\.") & ((F.size(F.split(n, r"\.")) >= 3) | n.endswith(".py") | n.rlike("^[A-Z]"))
    return F.filter(F.array_distinct(F.concat(ticked, loose)), fit)
