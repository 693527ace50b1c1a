"""Curated knowledge as tables and its links to symbols.

Tables: k_modules(module, title, description, layer), k_symbols(qualname,
title, description, keywords), k_requirements(req_id, title, description),
k_links(req_id, qualname, pos, origin in direct or linked), k_layers(layer,
module, pos).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .diff import first_wins


@dataclass
class Knowledge:
    modules: DataFrame
    symbols: DataFrame
    requirements: DataFrame
    links: DataFrame
    layers: DataFrame


def from_document(spark: SparkSession, doc: dict | None) -> Knowledge:
    """Tables of one knowledge document; anything but a mapping is empty."""
    doc = doc if isinstance(doc, dict) else {}
    part = lambda k: doc.get(k) if isinstance(doc.get(k), dict) else {}
    text = lambda x: None if x is None else str(x)
    modules = [(m, text(x.get("title")), text(x.get("description")), text(x.get("layer"))) for m, x in part("modules").items()]
    symbols = [(q, text(x.get("title")), text(x.get("description")), [str(k) for k in x.get("keywords") or []]) for q, x in part("symbols").items()]
    requirements = [(r, text(x.get("title")), text(x.get("description"))) for r, x in part("requirements").items()]
    links = [(str(r), q, i, "direct") for q, x in part("symbols").items() for i, r in enumerate(x.get("requirements") or [])]
    links += [(r, str(q), i, "linked") for r, x in part("requirements").items() for i, q in enumerate(x.get("linked_symbols") or [])]
    layers = [(layer, str(m), i) for layer, x in (part("architecture").get("layers") or {}).items() for i, m in enumerate((x.get("modules") if isinstance(x, dict) else x) or [])]
    make = spark.createDataFrame
    return Knowledge(
        make(modules, "module string, title string, description string, layer string"),
        make(symbols, "qualname string, title string, description string, keywords array<string>"),
        make(requirements, "req_id string, title string, description string"),
        make(links, "req_id string, qualname string, pos int, origin string"),
        make(layers, "layer string, module string, pos int"),
    )


def requirement_links(links: DataFrame) -> DataFrame:
    """Requirements of each symbol from both sides, direct ones first, each
    once: (qualname, req_id, ord)."""
    side = F.when(F.col("origin") == "direct", 0).otherwise(1)
    ranked = links.select("qualname", "req_id", F.struct(side.alias("side"), "pos", "req_id").alias("_o"))
    once = ranked.groupBy("qualname", "req_id").agg(F.min("_o").alias("_o"))
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("qualname").orderBy("_o")) - 1).drop("_o")


def requirement_ranks(links: DataFrame) -> DataFrame:
    """Smallest position of each symbol among the symbols requirements link."""
    return links.where("origin = 'linked'").groupBy("qualname").agg(F.min("pos").alias("requirement_rank"))


def entry(table: DataFrame, key: str, value: str) -> DataFrame:
    """What the knowledge says of one module, symbol or requirement: a row, or
    none."""
    return table.where(F.col(key) == value).limit(1)


def allowed_merge(target: Column, source: Column, allowed: tuple[str, ...]) -> Column:
    """A map with the allowed keys of another over its own, blanks aside."""
    over = F.map_filter(source, lambda k, v: k.isin(*allowed) & (F.trim(F.coalesce(v, F.lit(""))) != ""))
    return F.map_concat(F.map_filter(target, lambda k, _: ~F.map_contains_key(over, k)), over)


def requirement_details(k: Knowledge) -> DataFrame:
    """(qualname, req_id, ord, title, description); a missing title is the id."""
    found = requirement_links(k.links).join(k.requirements, "req_id", "left")
    return found.select("qualname", "req_id", "ord", F.coalesce(F.nullif("title", F.lit("")), "req_id").alias("title"), F.coalesce("description", F.lit("")).alias("description"))


def module_layers(k: Knowledge) -> DataFrame:
    """A module's own layer, else the first layer that lists it."""
    listed = first_wins(k.layers, ["module"], ["layer", "pos"]).select("module", F.col("layer").alias("_listed"))
    own = k.modules.select("module", F.nullif("layer", F.lit("")).alias("_own"))
    return own.join(listed, "module", "full_outer").select("module", F.coalesce("_own", "_listed").alias("layer")).where("layer is not null")


def layer_groups(rows: DataFrame, layer: str = "layer", module: str = "module") -> DataFrame:
    """Per layer its distinct modules, sorted, and their number."""
    return rows.where(F.col(layer).isNotNull()).groupBy(F.col(layer).alias("layer")).agg(F.array_sort(F.collect_set(module)).alias("modules")).withColumn("n", F.size("modules").cast("long"))


def bundled(symbols: DataFrame, k: Knowledge) -> DataFrame:
    """Symbols with what the knowledge says of them; missing texts are empty,
    missing layers null."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    m = k.modules.select(F.col("module").alias("module_name"), empty(F.col("title")).alias("module_title"), empty(F.col("description")).alias("module_description"))
    s = k.symbols.select("qualname", empty(F.col("title")).alias("symbol_title"), empty(F.col("description")).alias("symbol_description"), "keywords")
    reqs = requirement_details(k).groupBy("qualname").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("req_id").alias("id"), "title", "description"))).alias("requirements"))
    out = symbols.join(m, "module_name", "left").join(s, "qualname", "left").join(reqs, "qualname", "left").join(requirement_ranks(k.links), "qualname", "left")
    out = out.join(module_layers(k).withColumnRenamed("module", "module_name"), "module_name", "left")
    none = F.array().cast("array<struct<ord:int,id:string,title:string,description:string>>")
    out = out.withColumn("requirements", F.coalesce("requirements", none)).withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    out = out.withColumn("requirement_ids", F.transform("requirements", lambda r: r.id))
    return out.na.fill("", ["module_title", "module_description", "symbol_title", "symbol_description"])


def relations(k: Knowledge) -> DataFrame:
    """Edges the knowledge implies: module to layer, requirement to its
    symbols, symbol to its requirements; each once, all of high confidence."""
    edge = lambda df, s, kind, t: df.select(F.col(s).alias("source_qualname"), F.lit(kind).alias("relation_kind"), F.col(t).alias("target_ref"), F.col(t).alias("target_qualname"))
    direct, linked = k.links.where("origin = 'direct'"), k.links.where("origin = 'linked'")
    all_edges = edge(module_layers(k), "module", "belongs_to_layer", "layer").unionByName(edge(linked, "req_id", "implements_requirement", "qualname")).unionByName(edge(direct, "qualname", "implements_requirement", "req_id"))
    return all_edges.distinct().withColumn("relation_source", F.lit("knowledge")).withColumn("relation_confidence", F.lit("high"))


def search_documents(symbols: DataFrame, k: Knowledge) -> DataFrame:
    """One document per symbol that has any text, modules aside:
    (doc_id, qualname, file_path, source_kind, title, text)."""
    rows = bundled(symbols.where("kind <> 'module'"), k)
    parts = F.array(
        F.col("name"), F.col("qualname"), F.coalesce("docstring", F.lit("")), F.col("module_title"), F.col("module_description"), F.col("symbol_title"), F.col("symbol_description"),
        F.array_join("keywords", " "), F.array_join(F.transform("requirements", lambda r: F.concat_ws(" ", r.id, r.title, r.description)), "\n"), F.coalesce("layer", F.lit("")),
    )
    text = F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n")
    docs = rows.select(F.concat(F.lit("symbol::"), "qualname").alias("doc_id"), "qualname", "file_path", F.lit("symbol").alias("source_kind"), F.col("symbol_title").alias("title"), text.alias("text"))
    return docs.where(F.trim("text") != "")


def merged(existing: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Curated values over derived defaults, field by field; keys that are no
    longer derived go."""
    blank = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    both = derived.alias("d").join(existing.alias("e"), key, "left")
    return both.select(key, *[F.coalesce(blank(F.col(f"e.{c}")), F.col(f"d.{c}")).alias(c) for c in columns])


def unknown_keys(enrichment: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and rows to warn of because the index lacks their key."""
    names = known.select(key).distinct()
    return enrichment.join(names, key, "left_semi"), enrichment.join(names, key, "left_anti")


def default_keywords(name: Column, parent: Column) -> Column:
    """The name in words, and for a method its class's."""
    words = lambda c: F.trim(F.translate(c, "_-", "  "))
    owner = F.element_at(F.split(parent, r"\."), -1)
    return F.array_distinct(F.filter(F.array(words(name), words(owner)), lambda x: x.isNotNull() & (x != "")))


def merged_list(a: Column, b: Column) -> Column:
    """First ``a`` then ``b``, trimmed, without blanks, each once."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda x: F.trim(x)), lambda x: x != ""))


def overlap(a: Column, b: Column) -> Column:
    """Shared items over the smaller set's size; 0 where one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def traceability(links: DataFrame, applied: DataFrame) -> DataFrame:
    """Change requests of each requirement, blank ids dropped, each id once,
    the latest application kept: (req_id, change_request_id, applied_at)."""
    rows = links.unionByName(applied).where(F.trim("change_request_id") != "")
    return rows.groupBy("req_id", "change_request_id").agg(F.max("applied_at").alias("applied_at"))
