"""Change detection between versions of keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status(known: DataFrame, scanned: DataFrame, keys: list[str], value: str, force: bool = False) -> DataFrame:
    """Each key's status: new, changed, unchanged or deleted. ``force``
    re-extracts equal files, while deleted ones are still found."""
    a, b = known.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_a")), scanned.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    same = F.lit(False) if force else F.col("_old").eqNullSafe(F.col("_new"))
    return a.join(b, keys, "full_outer").select(
        *keys, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(same, "unchanged").otherwise("changed").alias("status")
    )


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def build_report(statuses: DataFrame) -> DataFrame:
    """One row: indexed, unchanged and deleted files."""
    count = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    return statuses.agg(count("new", "changed").alias("indexed"), count("unchanged").alias("unchanged"), count("deleted").alias("deleted"))


def set_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys added, removed or of changed content; all other columns count."""
    rest = [c for c in new.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*rest).alias(name), F.lit(True).alias(f"{name}_in"))
    both = pack(old, "_o").join(pack(new, "_n"), keys, "full_outer")
    kind = F.when(F.col("_o_in").isNull(), "added").when(F.col("_n_in").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed_content")
    return both.select(*keys, kind.alias("change")).where("change is not null")


def tree_changes(project: DataFrame, workspace: DataFrame) -> DataFrame:
    """Sorted paths that differ between two trees (file_path, sha256)."""
    return status(project, workspace, ["file_path"], "sha256").where("status <> 'unchanged'").select("file_path").orderBy("file_path")


def normal_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def base_guard(changed: DataFrame, baseline: DataFrame, current: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """State of each changed path against its baseline (file_path, exists,
    sha256) and the tree now (file_path, sha256): deleted_after_baseline,
    created_after_baseline, changed_after_baseline, ok, or unprotected where
    the baseline lacks the path. Excluded paths (in any letter case) are left
    out. Any of the first three blocks."""
    paths = changed.select(normal_path(F.col("file_path")).alias("file_path")).distinct()
    if excluded is not None:
        gone = excluded.select(F.lower(normal_path(F.col("file_path"))).alias("_x")).distinct()
        paths = paths.join(gone, F.lower("file_path") == F.col("_x"), "left_anti")
    base = baseline.select("file_path", F.col("exists").alias("_was"), F.col("sha256").alias("_old"), F.lit(True).alias("_base"))
    now = current.select("file_path", F.col("sha256").alias("_new"), F.lit(True).alias("_is"))
    rows = paths.join(base, "file_path", "left").join(now, "file_path", "left")
    state = (
        F.when(F.col("_base").isNull(), "unprotected")
        .when(F.col("_was") & F.col("_is").isNull(), "deleted_after_baseline")
        .when(~F.col("_was") & F.col("_is").isNotNull(), "created_after_baseline")
        .when(F.col("_was") & ~F.col("_old").eqNullSafe(F.col("_new")), "changed_after_baseline")
        .otherwise("ok")
    )
    return rows.select("file_path", state.alias("state"))


def guard_verdict(states: DataFrame) -> DataFrame:
    """blocked, ok, or skipped where no path has a baseline."""
    bad = F.col("state").endswith("_after_baseline")
    return states.agg(F.count_if(bad).alias("conflicts"), F.count_if(F.col("state") == "unprotected").alias("unprotected"), F.count("*").alias("n")).select(
        F.when(F.col("conflicts") > 0, "blocked").when((F.col("n") > 0) & (F.col("unprotected") == F.col("n")), "skipped").otherwise("ok").alias("verdict"), "conflicts", "unprotected"
    )


def apply_actions(changed: DataFrame, workspace: DataFrame, project: DataFrame) -> DataFrame:
    """What applying a workspace does to each path: copied, deleted or none."""
    src, dst = workspace.select("file_path", F.lit(True).alias("_s")), project.select("file_path", F.lit(True).alias("_d"))
    rows = changed.select("file_path").distinct().join(src, "file_path", "left").join(dst, "file_path", "left")
    return rows.select("file_path", F.when(F.col("_s"), "copied").when(F.col("_d"), "deleted").otherwise("none").alias("action"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each null-safe key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. One struct maximum per key, merged before
    the shuffle, so a hot key moves one row a task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_t"))
    return top.select(*keys, "_t.*").select(*df.columns)


def replaced(old: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """``old`` without the rows whose keys were touched (only those where
    ``only`` holds), and ``new``."""
    if only is None:
        kept = old.join(touched.select(*keys).distinct(), keys, "left_anti")
    else:
        kept = old.where(~F.coalesce(only, F.lit(False))).unionByName(old.where(only).join(touched.select(*keys).distinct(), keys, "left_anti"))
    return kept.unionByName(new)


def added_symbols(before: Column, after: Column, fallback: Column) -> Column:
    """Names in ``after`` but not ``before``, in order; else the fallback."""
    new = F.array_except(after, before)
    return F.when(F.size(new) > 0, new).otherwise(F.array(fallback))


def reconciled(docs: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of documents without a vector and vectors without a document."""
    a, b = docs.select(key).distinct().withColumn("_a", F.lit(1)), vectors.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").agg(
        F.count("_a").alias("documents"), F.count("_b").alias("vectors"), F.count_if(F.col("_b").isNull()).alias("missing_vectors"), F.count_if(F.col("_a").isNull()).alias("orphan_vectors")
    )
