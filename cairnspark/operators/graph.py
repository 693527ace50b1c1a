"""Operators over labelled edges: (source_qualname, relation_kind, target_ref,
target_qualname, relation_confidence, ord) or any columns in those roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored
from . import grams
from .search import top_per_key

# Edge kinds.
CALL_KINDS = ("calls", "covered_by_test", "exposed_by_controller")
NOT_RELATED = ("contains", "covered_by_test", "implements_requirement")


def is_test_path(c: Column) -> Column:
    return F.contains(F.concat(F.lit("/"), c), F.lit("/tests/"))


def edge_counts(edges: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """Edges of each key by kind, zeros filled."""
    return edges.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def histogram(edges: DataFrame, value: str, values: list[str], by: list[str] = []) -> DataFrame:  # noqa: B006
    counts = [F.count_if(F.col(value) == v).alias(v) for v in values]
    return edges.groupBy(*by).agg(*counts) if by else edges.agg(*counts)


def unique_names(symbols: DataFrame, name: str, key: str) -> DataFrame:
    """Names that exactly one symbol has: (name, key). Counted before any
    join, so an ambiguous name never multiplies rows."""
    return symbols.groupBy(name).agg(F.count("*").alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")


def resolved(edges: DataFrame, symbols: DataFrame, exact: str = "target_qualname", ref: str = "target_ref", key: str = "qualname", name: str = "name") -> DataFrame:
    """Adds ``resolved``: the exact target if it exists, else the only symbol
    of that short name, else null; and ``how``."""
    full = symbols.select(F.col(key).alias("_full")).distinct()
    short = unique_names(symbols, name, key).select(F.col(name).alias("_name"), F.col(key).alias("_short"))
    rows = edges.join(full, F.col(exact) == F.col("_full"), "left").join(short, F.col(ref) == F.col("_name"), "left")
    out = rows.withColumn("resolved", F.coalesce("_full", "_short"))
    return out.withColumn("how", F.when(F.col("_full").isNotNull(), "exact").when(F.col("_short").isNotNull(), "short_name").otherwise("unresolved")).drop("_full", "_name", "_short")


#: Roots that share the bits of one long, at most 64; hashed groups of about
#: so many are cut into such.
ROOTS_A_GROUP = 48


def _grouped(roots: DataFrame) -> DataFrame:
    """(root, group, bit) of distinct roots."""
    groups = -(-roots.count() // ROOTS_A_GROUP)
    place = F.row_number().over(Window.partitionBy("_g").orderBy("root")) - 1
    dealt = roots.withColumn("_g", F.pmod(F.xxhash64("root"), F.lit(max(1, groups)))).withColumn("_n", place)
    return dealt.select("root", (F.col("_g") + F.lit(max(1, groups)) * F.floor(F.col("_n") / 64)).cast("long").alias("group"), (F.col("_n") % 64).cast("int").alias("bit"))


def reach(edges: DataFrame, start: DataFrame, depth: int, src: str = "src", dst: str = "dst", expand: DataFrame | None = None) -> DataFrame:
    """Nodes from which ``start`` (root, node) is reached within ``depth``
    edges, with the fewest: (root, node, hops). Only nodes of ``expand``, if
    given, are passed through.

    Up to 64 roots are the bits of one long, so a node that many roots reach
    is one row for all of them. A level is one join on the node and a
    ``bit_or``; the bits that were not there before are those reached at this
    level, so cycles end. A level is written to the shared folder, and the
    next one reads it in place of working it out again; a hub's edges are a
    skewed join, which the adaptive planner splits."""
    back = edges.select(F.col(src).alias("_from"), F.col(dst).alias("node")).where("_from is not null and node is not null").distinct()
    back = stored(back, "edges") if depth > 1 else back
    begin = start.select("root", "node").where("root is not null and node is not null").distinct()
    roots = stored(_grouped(begin.select("root").distinct()), "roots")
    edge = stored(begin.join(roots, "root").groupBy("group", "node").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), "hop0")
    seen = levels = edge.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        via = edge if expand is None or hop == 1 else edge.join(expand.select("node").distinct(), "node", "left_semi")
        new = via.join(back, "node").groupBy("group", F.col("_from").alias("node")).agg(F.bit_or("bits").alias("bits"))
        known = seen.groupBy("group", "node").agg(F.bit_or("bits").alias("_known"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long"))))
        edge = new.join(known, ["group", "node"], "left").select("group", "node", fresh.alias("bits")).where("bits <> 0")
        if hop < depth:
            edge = stored(edge, f"hop{hop}")
            if edge.isEmpty():
                break
        seen = levels = levels.unionByName(edge.withColumn("hops", F.lit(hop)))
    set_ = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(F.col("bits"), b) == 1)
    return levels.select("group", "node", "hops", F.explode(set_).alias("bit")).join(roots, ["group", "bit"]).select("root", "node", "hops")


def unresolved(names: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Names that nothing known has, each once."""
    return names.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def related_tests(edges: DataFrame, symbols: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """Tests that reach each root within ``depth`` call edges through symbols
    that are no tests: (root, test, hops)."""
    calls = edges.where(F.col("relation_kind").isin(*CALL_KINDS)).select(F.col("source_qualname").alias("src"), F.col("target_qualname").alias("dst"))
    tests = symbols.where(is_test_path(F.col("file_path"))).select(F.col("qualname").alias("node"))
    plain = symbols.where(~is_test_path(F.col("file_path"))).select(F.col("qualname").alias("node"))
    found = reach(calls, start, depth, expand=plain).where("hops > 0")
    return found.join(tests, "node", "left_semi").select("root", F.col("node").alias("test"), "hops")


def impact(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """Callers within ``depth`` edges: (root, caller, hops, is_test)."""
    calls = edges.where(F.col("relation_kind").isin(*CALL_KINDS))
    tests = calls.where("relation_kind = 'covered_by_test'").select(F.col("source_qualname").alias("node"), F.col("target_qualname").alias("root")).distinct()
    found = reach(calls.select(F.col("source_qualname").alias("src"), F.col("target_qualname").alias("dst")), start, depth).where("hops > 0")
    covered = found.join(tests.withColumn("_t", F.lit(True)), ["root", "node"], "left")
    return covered.select("root", F.col("node").alias("caller"), "hops", (F.col("node").startswith("tests.") | F.coalesce("_t", F.lit(False))).alias("is_test"))


def test_commands(tests: DataFrame, symbols: DataFrame) -> DataFrame:
    """``pytest <file>`` once for each file of the tests."""
    return tests.join(symbols.select(F.col("qualname").alias("test"), "file_path"), "test").select(F.concat(F.lit("pytest "), "file_path").alias("command")).distinct().orderBy("command")


def children(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of a class's methods with the class: (class_qualname, edge columns)."""
    methods = symbols.where("kind = 'method'").select(F.col("parent_qualname").alias("class_qualname"), F.col("qualname").alias("source_qualname"))
    return methods.join(edges, "source_qualname")


def file_based_tests(symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """Tests whose file is named after the target's module, or whose name
    holds the target's name: (qualname of the target, test). Names of tests
    and targets meet by runs of letters; the test's full name holds its short
    one, and a target's name found in either counts."""
    tests = symbols.where(is_test_path(F.col("file_path")) & F.col("kind").isin("function", "method")).select(
        F.col("qualname").alias("test"), F.lower("name").alias("_tname"), F.lower("qualname").alias("_tqual"), F.regexp_extract("file_path", r"([^/]+)\.py$", 1).alias("_stem")
    )
    wanted = targets.select("qualname", F.lower("name").alias("_name"), F.concat(F.lit("test_"), F.element_at(F.split("module_name", r"\."), -1)).alias("_file"))
    by_file = tests.join(wanted, F.col("_stem") == F.col("_file")).select("qualname", "test")
    shown = tests.select("test", F.explode(F.array_distinct(F.array("_tname", "_tqual"))).alias("hay"))
    held = grams.contained(shown, wanted.select(F.col("_name").alias("needle")))
    by_name = shown.join(held, "hay").join(wanted.select("qualname", F.col("_name").alias("needle")), "needle").select("qualname", "test")
    return by_file.unionByName(by_name).distinct()


def related_symbols(edges: DataFrame, symbols: DataFrame, targets: DataFrame, keep: int = 12) -> DataFrame:
    """Symbols that edges join to each target, the first edge of each symbol:
    outbound before inbound, in the order of ``ord``."""
    use = edges.where(~F.col("relation_kind").isin(*NOT_RELATED))
    names = targets.select(F.col("qualname").alias("root"))
    out = resolved(use, symbols).join(names, F.col("source_qualname") == F.col("root")).select("root", F.col("resolved").alias("qualname"), "relation_kind", "relation_confidence", F.lit("outbound").alias("direction"), "ord")
    into = use.join(names, F.col("target_qualname") == F.col("root")).select("root", F.col("source_qualname").alias("qualname"), "relation_kind", "relation_confidence", F.lit("inbound").alias("direction"), "ord")
    rows = out.unionByName(into).where("qualname is not null and qualname <> root")
    order = [F.when(F.col("direction") == "outbound", 0).otherwise(1), F.col("ord")]
    first = top_per_key(rows, ["root", "qualname"], order, 1, "_first").drop("_first")
    plain = symbols.where(~is_test_path(F.col("file_path"))).select("qualname", "name", "kind", "file_path")
    return top_per_key(first.join(plain, "qualname"), ["root"], [*order, F.col("qualname")], keep)


def context_pack(symbols: DataFrame, edges: DataFrame, targets: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Per target one row of nested parts: neighbours in its file, inbound and
    outbound edges (inbound by short name where none has the full name),
    related tests, related symbols and the confidence histogram."""
    most = {"neighbors": 8, "inbound": 16, "outbound": 16, "tests": 8, "related": 12} | (limits or {})
    t = targets.join(symbols, "qualname").select("qualname", "name", "file_path", "module_name", "kind")
    near = symbols.select("file_path", F.col("qualname").alias("other"), "start_line").join(t.select("qualname", "file_path"), "file_path").where("other <> qualname")
    near = top_per_key(near, ["qualname"], [F.col("start_line"), F.col("other")], most["neighbors"])
    shown = edges.where("relation_kind <> 'contains'")
    out = shown.join(t.select("qualname"), F.col("source_qualname") == F.col("qualname")).withColumn("other", F.coalesce("target_qualname", "target_ref"))
    into = shown.join(t.select("qualname"), F.col("target_qualname") == F.col("qualname")).withColumn("other", F.col("source_qualname"))
    none = t.join(into.select("qualname").distinct(), "qualname", "left_anti").select("qualname", F.col("name").alias("_ref"))
    by_name = shown.join(none, F.col("target_ref") == F.col("_ref")).withColumn("other", F.col("source_qualname")).drop("_ref")
    into = into.unionByName(by_name)
    part = lambda df, name: df.groupBy("qualname").agg(F.array_sort(F.collect_list(F.struct("rank", "relation_kind", "other"))).alias(name))
    top_out = part(top_per_key(out, ["qualname"], [F.col("relation_kind"), F.col("other"), F.col("ord")], most["outbound"]), "outbound")
    top_in = part(top_per_key(into, ["qualname"], [F.col("other"), F.col("ord")], most["inbound"]), "inbound")
    found = related_tests(edges, symbols, t.select(F.col("qualname").alias("root"), F.col("qualname").alias("node"))).select(F.col("root").alias("qualname"), "test", "hops")
    tests = found.unionByName(file_based_tests(symbols, t).withColumn("hops", F.lit(9))).groupBy("qualname", "test").agg(F.min("hops").alias("hops"))
    tests = top_per_key(tests, ["qualname"], [F.col("hops"), F.col("test")], most["tests"])
    related = related_symbols(edges, symbols, t, most["related"]).select(F.col("root").alias("qualname"), F.struct("rank", F.col("qualname").alias("symbol"), "direction").alias("_r"))
    levels = ["high", "medium", "low"]
    sure = histogram(out.select("qualname", "relation_confidence").unionByName(into.select("qualname", "relation_confidence")), "relation_confidence", levels, ["qualname"])
    pack = t.join(near.groupBy("qualname").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("neighbors")), "qualname", "left")
    pack = pack.join(top_in, "qualname", "left").join(top_out, "qualname", "left")
    pack = pack.join(tests.groupBy("qualname").agg(F.array_sort(F.collect_list(F.struct("rank", "test", "hops"))).alias("tests")), "qualname", "left")
    pack = pack.join(related.groupBy("qualname").agg(F.array_sort(F.collect_list("_r")).alias("related")), "qualname", "left")
    return pack.join(sure, "qualname", "left").na.fill(0, levels)


def longest_prefix(df: DataFrame, key: str, known: DataFrame, prefix: str, separator: str = r"\.", glue: str = ".") -> DataFrame:
    """Adds ``nearest``: the longest known prefix of whole segments, itself
    included. Prefixes are exploded and met by equality, never by a scan."""
    parts = df.select(key).distinct().withColumn("_p", F.split(key, separator))
    each = parts.select(key, F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_n"), "_p").select(key, "_n", F.array_join(F.slice("_p", F.lit(1), F.col("_n")), glue).alias("_prefix"))
    hit = each.join(known.select(F.col(prefix).alias("_prefix")).distinct(), "_prefix").groupBy(key).agg(F.max_by("_prefix", "_n").alias("nearest"))
    return df.join(hit, key, "left")


def aliases(symbols: DataFrame, key: str = "qualname", most: int = 4) -> DataFrame:
    """Dotted tails of up to ``most`` segments that stand for one symbol only:
    (alias, qualname)."""
    parts = symbols.select(key).distinct().withColumn("_p", F.split(key, r"\."))
    tails = parts.select(key, "_p", F.explode(F.sequence(F.lit(1), F.least(F.size("_p"), F.lit(most)))).alias("_n"))
    tails = tails.select(key, F.array_join(F.slice("_p", F.size("_p") - F.col("_n") + 1, F.col("_n")), ".").alias("alias"))
    return tails.groupBy("alias").agg(F.count_distinct(key).alias("_c"), F.min(key).alias(key)).where("_c = 1").drop("_c")


def cascade(refs: DataFrame, column: str, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Adds ``target`` and ``step``: the first of the named (ref, target)
    tables that knows the reference. Tables hold a reference once."""
    out, names = refs, []
    for name, table in tables:
        out = out.join(table.select(F.col("ref").alias(f"_k_{name}"), F.col("target").alias(f"_t_{name}")), F.col(column) == F.col(f"_k_{name}"), "left")
        names.append(name)
    step = F.coalesce(*[F.when(F.col(f"_t_{n}").isNotNull(), n) for n in names])
    return out.select(*refs.columns, F.coalesce(*[F.col(f"_t_{n}") for n in names]).alias("target"), step.alias("step"))


def ranged(df: DataFrame, size: str, first: str, ranges: int, rows: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` with ``_range``, cut at quantiles of a numeric column, and each
    range's total; there are more ranges for more rows, up to 10,000."""
    n = min(max(ranges, df.count() // rows), 10_000)
    key = F.col(first).cast("double")
    marks = sorted(set(df.select(key.alias("_q")).approxQuantile("_q", [k / n for k in range(1, n)], min(0.001, 0.2 / n)))) if n > 1 else []
    listed = F.array(*[F.lit(m) for m in marks])
    out = df.withColumn("_range", F.size(F.filter(listed, lambda m: m < key)) if marks else F.lit(0))
    return out, sorted((r["_range"], r["_n"]) for r in out.groupBy("_range").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_n")).collect())


def running_total(df: DataFrame, size: str, order: list[str], ranges: int = 256, rows: int = 1_000_000, budget: int | None = None) -> DataFrame:
    """Adds ``running``, the sum of ``size`` up to each row in the order of
    ``order`` (a numeric column first, unique together). The rows are cut at
    quantiles of the first column; sums of whole ranges are added to sums
    within each, so no task holds more than one range. With a ``budget``, only
    ranges up to the one that passes it are put in order."""
    out, sums = ranged(df, size, order[0], ranges, rows)
    before, total = [], 0
    for k, n in sums:
        before.append((k, total))
        total += n
        if budget is not None and total > budget:
            break
    table = df.sparkSession.createDataFrame(before, "_range int, _before long")  # one row per range
    own = F.sum(size).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = out.join(F.broadcast(table), "_range")
    return kept.withColumn("running", own + F.col("_before")).drop("_before", "_range")


def running_budget(df: DataFrame, size: str, order: list[str], budget: int) -> DataFrame:
    """Rows whose running total stays within the budget, in order. Sizes are
    not negative."""
    return running_total(df, size, order, budget=budget).where(F.col("running") <= budget)
