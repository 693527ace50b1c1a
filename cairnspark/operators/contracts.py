"""Surfaces of classes and calls, derived from facts and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import top_per_key
from .validate import of


def class_fields(facts: DataFrame) -> DataFrame:
    """(unit, type, field, note, required): constructor parameters where a
    class has a constructor, else its annotated fields."""
    return of(facts, "field").select("unit", F.col("owner").alias("type"), F.col("name").alias("field"), F.col("detail").alias("note"), (F.col("n") == 1).alias("required"), "line").distinct()


def model_surfaces(facts: DataFrame) -> DataFrame:
    """Per class its fields in source order."""
    each = class_fields(facts).groupBy("unit", "type").agg(F.array_sort(F.collect_list(F.struct("line", "field", "note", "required"))).alias("fields"))
    return each.withColumn("fields", F.transform("fields", lambda x: F.struct(x.field.alias("field"), x.note.alias("note"), x.required.alias("required"))))


def call_paths(facts: DataFrame) -> DataFrame:
    """Dotted names of calls, each once per unit."""
    return of(facts, "call").where("detail <> 'expression'").select("unit", F.col("name").alias("path")).distinct()


def attribute_types(relations: DataFrame) -> DataFrame:
    """(class, attribute call target's type): owners that resolved calls of a
    class's methods go to."""
    rows = relations.where("relation_kind = 'calls' and target_qualname is not null")
    cut = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    return rows.select(cut(F.col("source_qualname")).alias("class"), cut(F.col("target_qualname")).alias("type")).distinct().where("class <> type")


def import_rows(relations: DataFrame) -> DataFrame:
    return relations.where("relation_kind = 'imports'").select(F.col("source_qualname").alias("module"), F.col("target_ref").alias("alias"), F.col("target_qualname").alias("target"))


def required_members(symbols: DataFrame, classes: DataFrame, removal: bool = False) -> DataFrame:
    """Public methods and the constructor of each class, required unless a
    removal was asked for: (class_qualname, member, required)."""
    methods = symbols.where("kind = 'method'").select(F.col("parent_qualname").alias("class_qualname"), F.col("name").alias("member"), "start_line")
    rows = methods.join(classes, "class_qualname", "left_semi").where("not startswith(member, '_') or member = '__init__'")
    return rows.select("class_qualname", "member", F.lit(not removal).alias("required"))


def api_surface(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Calls whose method name exactly one type owns, with that type:
    (unit, path, type, member)."""
    owners = members.select("type", "member").distinct().groupBy("member").agg(F.count("*").alias("_n"), F.min("type").alias("type")).where("_n = 1").drop("_n")
    return call_paths(facts).withColumn("member", F.element_at(F.split("path", r"\."), -1)).join(owners, "member").select("unit", "path", "type", "member")


def attribute_needs(reads: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields that each contract parameter is read for, those known of its
    item type: (contract, param, item_type, fields sorted)."""
    known = fields.select(F.col("type").alias("item_type"), "field").distinct()
    return reads.join(known, ["item_type", "field"], "left_semi").groupBy("contract", "param", "item_type").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def required_contracts(functions: DataFrame, topics: list[str], reuse: bool) -> DataFrame:
    """Free functions a request must use: those whose text names a topic, or
    the only function where none does; nothing without a sign of reuse."""
    if not reuse:
        return functions.limit(0)
    about = F.lower(F.concat_ws(" ", "name", F.coalesce("docstring", F.lit(""))))
    hit = F.lit(not topics)
    for t in topics:
        hit = hit | F.contains(about, F.lit(t.lower()))
    marked = functions.withColumn("_hit", hit)
    counts = marked.agg(F.count("*").alias("_all"), F.count_if("_hit").alias("_hits"))
    return marked.crossJoin(F.broadcast(counts)).where("_hit or (_hits = 0 and _all = 1)").drop("_hit", "_all", "_hits")


def consumers(relations: DataFrame, module: str, defined: list[str], most: int = 3) -> DataFrame:
    """Files, tests aside, that import names from ``module`` which it does
    not define, the first few by path: (file_path, names)."""
    rows = relations.where((F.col("relation_kind") == "imports") & F.col("target_qualname").startswith(module + ".") & ~F.contains(F.concat(F.lit("/"), "file_path"), F.lit("/tests/")))
    rows = rows.select("file_path", F.substring("target_qualname", len(module) + 2, 1000).alias("name")).where(~F.col("name").isin(defined) if defined else F.lit(True))
    return rows.groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("names")).orderBy("file_path").limit(most)


def excerpt(source: Column, names: Column, gap: str = "...") -> Column:
    """Import lines and lines that hold one of the names, a gap mark between
    lines that did not follow each other."""
    lines = F.split(source, "\n")
    pattern = F.concat(F.lit(r"(^|[^A-Za-z0-9_])("), F.array_join(names, "|"), F.lit(r")([^A-Za-z0-9_]|$)"))
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s.x.rlike(r"^\s*(import|from)\s") | F.regexp_like(s.x, pattern))
    marked = F.transform(kept, lambda s, k: F.when((k > 0) & (F.get(kept, k - 1).i < s.i - 1), F.concat(F.lit(gap + "\n"), s.x)).otherwise(s.x))
    return F.array_join(marked, "\n")


def item_type(note: Column) -> Column:
    """Item type of a list, set or tuple annotation; null for others."""
    return F.nullif(F.trim(F.regexp_extract(note, r"^(?:typing\.)?(?:[Ll]ist|[Ss]et|[Tt]uple|FrozenSet|frozenset|Sequence|Iterable)\[([^\[\],]+)", 1)), F.lit(""))


def selected_tests(tests: DataFrame, limit: int = 1) -> DataFrame:
    """Tests of each target, whole modules last, short ones first; a limit
    under one still gives one."""
    order = [F.col("is_module"), F.length("source_code"), F.col("qualname")]
    return top_per_key(tests, ["target"], order, max(limit, 1))


def deduped_payloads(rows: DataFrame) -> DataFrame:
    """First of each qualname, or of each name where that is missing."""
    return rows.withColumn("_k", F.coalesce(F.nullif("qualname", F.lit("")), "name")).groupBy("_k").agg(F.min_by(F.struct(*rows.columns), "ord").alias("_r")).select("_r.*")
