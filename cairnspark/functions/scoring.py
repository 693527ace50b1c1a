"""The weighted multi-field score as column expressions.

Field points are whole hundredths, so lexical scores are exact decimals. A
query is an array of terms; the same expression serves one query or a table
of queries.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import TERM_PATTERN, match_kind, normalise, tokens

# Field weights in tie order, in hundredths of a point, the
# multipliers of the match kinds and the bonuses.
FIELD_WEIGHTS = {
    "name": 340, "qualname": 200, "file_path": 100, "docstring": 280, "module_title": 140, "module_description": 180,
    "symbol_title": 300, "symbol_description": 320, "keywords": 260, "requirement_text": 240, "layer": 80,
}
MULTIPLIERS = {"exact_token": 100, "substring": 75, "stem": 55}
TEXT_QUERY_STEMS = ("текст", "уведомл", "формулиров", "сообщен")
TEXT_SYMBOL_STEMS = ("message", "уведомл", "текст", "сообщен", "формулиров")
MODEL_NAMES = ("summary", "model", "dto", "schema", "entity")
BUILDER_NAMES = ("build_", "create_", "update_", "assign_")
CATEGORY = {"high": "высокая", "medium": "средняя", "low": "низкая"}
VECTOR_WEIGHT = 4.0
FIELD_LABELS = {
    "name": "имени символа", "qualname": "полном имени символа", "file_path": "пути к файлу", "docstring": "docstring в коде", "module_title": "названии модуля из knowledge",
    "module_description": "описании модуля из knowledge", "symbol_title": "названии символа из knowledge", "symbol_description": "описании символа из knowledge",
    "keywords": "keywords из knowledge", "requirement_text": "связанных требованиях", "layer": "архитектурном слое",
}
MATCH_LABELS = {"exact_token": "точное совпадение", "substring": "совпадение", "stem": "совпадение по основе слова"}
REASON_TERM = "термин «%s» дал %s в %s"
REASON_VECTOR = "векторное сходство по human-readable описаниям: %.2f"
REASON_KIND = "это исполняемая точка логики: функция или метод"
REASON_SERVICES = "символ находится в service-слое, который обычно является основной точкой бизнес-логики"
REASON_STORAGE = "domain/storage-слой чаще хранит данные или инфраструктуру, а не основной use-case"
REASON_KNOWLEDGE = "для символа есть knowledge-описание в overlay"
REASON_REQUIREMENT = "символ явно связан с requirement-артефактами"
REASON_FIRST = "symbol указан как первичная точка реализации требования"


def with_fields(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Adds ``_fields``: each field's normal form and tokens, computed once."""
    plain = F.array(*[F.struct(F.lit(k).alias("field"), normalise(F.coalesce(c.cast("string"), F.lit(""))).alias("text")) for k, c in fields.items()])
    return df.withColumn("_plain", plain).withColumn("_fields", F.transform("_plain", lambda f: F.struct(f.field.alias("field"), f.text.alias("text"), tokens(f.text).alias("tokens")))).drop("_plain")


def matches(terms: Column, fields: Column, weights: Mapping[str, int]) -> Column:
    """Per matched term its best field: the first with the most points.
    ``terms`` is an array of (term, root)."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])

    def best(t: Column) -> Column:
        kinds = F.transform(fields, lambda f: F.struct(f.field.alias("field"), match_kind(t.term, t.root, f.text, f.tokens).alias("kind")))
        scored = F.transform(
            F.filter(kinds, lambda k: k.kind.isNotNull()),
            lambda k: F.struct((F.element_at(weight, k.field) * F.when(k.kind == "exact_token", MULTIPLIERS["exact_token"]).when(k.kind == "substring", MULTIPLIERS["substring"]).otherwise(MULTIPLIERS["stem"]) / 100).cast("int").alias("points"), k.field.alias("field"), k.kind.alias("kind")),
        )
        top = F.array_max(F.transform(scored, lambda s: s.points))
        return F.struct(t.term.alias("term"), F.get(F.filter(scored, lambda s: s.points == top), 0).alias("best"))

    return F.filter(F.transform(terms, best), lambda m: m.best.isNotNull())


def literal_terms(terms: list[tuple[str, str]]) -> Column:
    """Terms of a query known beforehand, as ``matches`` takes them."""
    if not terms:
        return F.array().cast("array<struct<term:string,root:string>>")
    return F.array(*[F.struct(F.lit(t).alias("term"), F.lit(r).alias("root")) for t, r in terms])


def best_points(terms: list[tuple[str, str]], fields: Mapping[str, Column], weights: Mapping[str, int]) -> list[Column]:
    """Per term of a query known beforehand the best points of any field, in
    hundredths. ``fields`` are normal forms. Only plain comparisons, which
    compile into the stage; a term is a whole token where no letter or
    underscore touches it."""
    letters = TERM_PATTERN[1 : TERM_PATTERN.index("]")]

    def one(term: str, root: str, field: Column, w: int) -> Column:
        whole = field.rlike(f"(?<![{letters}]){re.escape(term)}(?![{letters}])")
        inside = F.when(whole, w).otherwise(w * MULTIPLIERS["substring"] // 100)
        out = F.when(F.contains(field, F.lit(term)), inside)
        return (out.when(F.contains(field, F.lit(root)), w * MULTIPLIERS["stem"] // 100) if root and root != term else out).otherwise(0)

    each = [[one(t, r, c, weights[f]) for f, c in fields.items()] for t, r in terms]
    return [F.greatest(*cols) if len(cols) > 1 else cols[0] for cols in each]


def total(points_: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, points_, F.lit(0))


def lexical(matched: Column) -> Column:
    """Sum of the best points in hundredths."""
    return F.aggregate(matched, F.lit(0), lambda acc, m: acc + m.best.points)


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def points(condition: Column, value: float) -> Column:
    """``value`` in hundredths where the condition holds, null counting as no."""
    return F.when(condition, round(value * 100)).otherwise(0)


def symbol_bonus(matched: Column) -> Column:
    """Kind, layer, knowledge, requirement and several-terms bonuses over the
    columns kind, layer, symbol_title, symbol_description, requirement_ids
    and requirement_rank, in hundredths."""
    n = F.size(matched)
    described = (F.coalesce("symbol_title", F.lit("")) != "") | (F.coalesce("symbol_description", F.lit("")) != "")
    return (
        points(F.col("kind").isin("function", "method"), 0.8)
        + F.when(F.col("layer") == "services", 75).when(F.col("layer") == "storage", -35).otherwise(0)
        + points(described, 0.55)
        + points(F.size("requirement_ids") > 0, 0.65)
        + points((F.size("requirement_ids") > 0) & (F.col("requirement_rank") == 0), 0.45)
        + F.when(n >= 2, F.least(n, F.lit(5)) * 20).otherwise(0)
    )


def reasons(matched: Column) -> Column:
    """Why a symbol was found: its vector, its terms in order, and what the
    bonuses of ``symbol_bonus`` are for."""
    label = lambda table, c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), c)
    terms = F.transform(matched, lambda m: F.format_string(REASON_TERM, m.term, label(MATCH_LABELS, m.best.kind), label(FIELD_LABELS, m.best.field)))
    described = (F.coalesce("symbol_title", F.lit("")) != "") | (F.coalesce("symbol_description", F.lit("")) != "")
    bonuses = F.array(
        F.when(F.col("kind").isin("function", "method"), REASON_KIND),
        F.when(F.col("layer") == "services", REASON_SERVICES).when(F.col("layer") == "storage", REASON_STORAGE),
        F.when(described, REASON_KNOWLEDGE),
        F.when(F.size("requirement_ids") > 0, REASON_REQUIREMENT),
        F.when((F.size("requirement_ids") > 0) & (F.col("requirement_rank") == 0), REASON_FIRST),
    )
    return F.array_compact(F.concat(F.array(F.when(F.col("similarity") > 0, F.format_string(REASON_VECTOR, "similarity"))), terms, bonuses))


def intent_bonus(query: Column) -> Column:
    """For queries about texts and notifications, in hundredths."""
    about = F.concat_ws(" ", "name", F.coalesce("docstring", F.lit("")), F.coalesce("symbol_title", F.lit("")), F.coalesce("symbol_description", F.lit("")))
    rules = (
        points(contains_any(normalise(about), TEXT_SYMBOL_STEMS), 2.0)
        + points((F.col("layer") == "services") & F.col("name").startswith("build_"), 1.4)
        + points(F.col("name").startswith("assign_"), -1.6)
        + points(F.contains("qualname", F.lit(".notification_service.")), 1.2)
    )
    return F.when(contains_any(normalise(query), TEXT_QUERY_STEMS), rules).otherwise(0)


def insertion_bonus(domain_prefix: str = "") -> Column:
    """For requests to insert after a symbol, in hundredths."""
    path, name, kind = F.lower("file_path"), F.lower("name"), F.col("kind")
    in_domain = F.contains(path, F.lit("/domain/")) | (path.startswith(domain_prefix) if domain_prefix else F.lit(False))
    return (
        F.when(kind == "class", 180).when(kind.isin("function", "method"), -35).otherwise(0)
        + F.when(F.col("layer") == "services", -80).when(F.col("layer").isin("domain", "api"), 45).otherwise(0)
        + points(in_domain, 0.9)
        + points(F.contains(path, F.lit("/models.py")) | path.endswith("models.py"), 1.2)
        + points((kind == "class") & contains_any(name, MODEL_NAMES), 0.6)
        + points((kind == "method") & contains_any(name, BUILDER_NAMES), -0.4)
    )


def confidence(score: Column) -> Column:
    """0.12 + score / 22, rounded to two places and at most one; 0 for no score."""
    return F.when(score > 0, F.least(F.lit(1.0), F.round(F.lit(0.12) + score / 22.0, 2))).otherwise(0.0)


def category(score: Column, sure: Column, labels: Mapping[str, str] = CATEGORY) -> Column:
    return F.when((sure >= 0.7) & (score >= 9.0), labels["high"]).when((sure >= 0.4) & (score >= 4.0), labels["medium"]).otherwise(labels["low"])


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine over array<double>; null for a zero vector."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1.0 - dot(a, b) / norm)
