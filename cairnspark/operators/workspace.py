"""Edits, diffs and baselines of workspaces, and budgets of prompts."""

from __future__ import annotations

import difflib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unified_diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, diff) for files (file_path, content binary) that differ;
    files that are not UTF-8 in either tree are left out."""

    @F.pandas_udf("string")
    def diff(path: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["".join(difflib.unified_diff((x or "").splitlines(True), (y or "").splitlines(True), f"a/{p}", f"b/{p}")) for p, x, y in zip(path, a, b, strict=True)])

    text = lambda c: F.decode(c, "utf-8")
    both = before.select("file_path", F.col("content").alias("_a")).join(after.select("file_path", F.col("content").alias("_b")), "file_path", "full_outer")
    utf8 = lambda c: F.col(c).isNull() | F.is_valid_utf8(F.col(c).cast("string"))
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).where(utf8("_a") & utf8("_b")).select("file_path", diff("file_path", text("_a"), text("_b")).alias("diff"))


def spliced(source: Column, start: Column, end: Column, code: Column, after: bool = False) -> Column:
    """Lines start..end replaced by ``code``, or ``code`` put after them."""
    lines = F.split(source, "\n")
    head = F.slice(lines, F.lit(1), end if after else start - 1)
    tail = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return F.array_join(F.concat(head, F.split(code, "\n"), tail), "\n")


def imports_edited(source: Column, add: Column, remove: Column) -> Column:
    """Lines of ``remove`` gone, those of ``add`` that are missing put before
    the first import (or at the head)."""
    lines = F.filter(F.split(source, "\n"), lambda x: ~F.array_contains(remove, F.trim(x)))
    new = F.array_except(add, F.transform(lines, lambda x: F.trim(x)))
    first = F.coalesce(F.get(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^(import|from)\s"), i + 1)), lambda i: i.isNotNull()), 0), F.lit(1))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), first - 1), new, F.slice(lines, first, F.size(lines))), "\n")


def baseline(planned: DataFrame, files: DataFrame) -> DataFrame:
    """Baseline of planned paths: exists, sha256, size and mtime, nulls for
    files that are not there; a path once."""
    now = files.select("file_path", F.lit(True).alias("_is"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return planned.select("file_path").distinct().join(now, "file_path", "left").select("file_path", F.coalesce("_is", F.lit(False)).alias("exists"), "sha256", "size", "mtime_ns")


def deduped_targets(targets: DataFrame) -> DataFrame:
    """Test targets, a file gone where one of its nodes is named."""
    node = targets.where(F.contains("target", F.lit("::"))).select(F.element_at(F.split("target", "::"), 1).alias("target")).distinct()
    return targets.join(node, "target", "left_anti")


def resolved_targets(targets: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dotted test names as files and nodes: the longest prefix that is a
    file, with its node where it exists: (target, path, status). ``nodes``:
    (path, node)."""
    parts = targets.select("target").distinct().withColumn("_p", F.split("target", r"\."))
    each = parts.select("target", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_n"))
    each = each.select("target", "_n", F.concat(F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "/"), F.lit(".py")).alias("path"), F.array_join(F.slice("_p", F.col("_n") + 1, F.size("_p")), "::").alias("node"))
    hit = each.join(files.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi").join(nodes.withColumn("_has", F.lit(True)), ["path", "node"], "left")
    status = F.when((F.col("node") == "") | F.col("_has"), 0).otherwise(1)
    best = hit.groupBy("target").agg(F.min(F.struct(status.alias("s"), -F.col("_n"), F.col("path"), F.col("node"))).alias("_b"))
    out = targets.join(best, "target", "left")
    path = F.when(F.col("_b.s") == 0, F.concat_ws("::", "_b.path", F.nullif("_b.node", F.lit("")))).otherwise(F.col("_b.path"))
    return out.select("target", path.alias("path"), F.when(F.col("_b").isNull(), "unresolved").when(F.col("_b.s") == 0, "resolved").otherwise("fallback_file").alias("status"))


def target_batch(targets: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Test targets (target, pos) as a run takes them: (target, path, status,
    pos, run_pos); ``run_pos`` is null for those that another of the same path
    or of its file's node stands for, and for unresolved ones."""
    clean = targets.withColumn("target", F.trim("target")).where("target <> ''")
    found = resolved_targets(clean.select("target").distinct(), files, nodes).join(clean, "target")
    first = found.where("path is not null").groupBy("path").agg(F.min("pos").alias("_first"))
    kept = deduped_targets(first.withColumnRenamed("path", "target")).select(F.col("target").alias("path"), "_first")
    return found.join(kept, "path", "left").select("target", "path", "status", "pos", F.when(F.col("pos") == F.col("_first"), F.col("pos")).alias("run_pos"))


def all_targets(recommended: Column, generated: Column) -> Column:
    """Recommended then generated test targets, blanks aside, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(recommended, none), F.coalesce(generated, none)), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))


def applied(spark: SparkSession, actions: DataFrame, workspace: str, project: str) -> dict[str, int]:
    """Carry out the actions of ``diff.apply_actions`` on two trees: copied
    files first, then deleted ones; how many of each. Paths that leave the
    trees are refused before anything is done."""
    rows = actions.where("action <> 'none'").orderBy("file_path").collect()
    for r in rows:
        if r["file_path"].startswith("/") or ".." in r["file_path"].split("/"):
            raise ValueError(f"unsafe path {r['file_path']}")
    hadoop, conf, out = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), {"copied": 0, "deleted": 0}
    for r in sorted(rows, key=lambda r: r["action"]):
        source, target = (hadoop.Path(f"{root.rstrip('/')}/{r['file_path']}") for root in (workspace, project))
        to = target.getFileSystem(conf)
        if r["action"] == "copied":
            hadoop.FileUtil.copy(source.getFileSystem(conf), source, to, target, False, True, conf)
        else:
            to.delete(target, False)
        out[r["action"]] += 1
    return out


def clipped(payload: dict, path: str, chars: int) -> dict:
    return payload | {path: [{k: (v[:chars] if isinstance(v, str) else v) for k, v in card.items()} for card in payload.get(path, [])]}


Step = tuple[str, Callable[[dict], dict | None]]


def within_budget(payload: dict, size: Callable[[dict], int], limit: int, steps: list[Step], soft: float = 1.0) -> tuple[dict, list[str]]:
    """Apply shrinking steps in order, each as long as it changes anything,
    until the payload fits; the log of steps taken. Beyond the limit, a
    payload within ``limit * soft`` still passes; else an error."""
    log: list[str] = []
    for name, shrink in steps:
        while size(payload) > limit:
            smaller = shrink(payload)
            if smaller is None or smaller == payload:
                break
            payload = smaller
            log.append(name)
    if size(payload) > limit * soft:
        raise ValueError(f"prompt of {size(payload)} characters exceeds {limit}")
    return payload, log


def json_size(payload: dict) -> int:
    return len(json.dumps(payload, ensure_ascii=False))


def halve(path: str, least: int = 1) -> Callable[[dict], dict | None]:
    """Keep the first half of a list."""

    def step(payload: dict) -> dict | None:
        items = payload.get(path) or []
        return payload | {path: items[: max(least, len(items) // 2)]} if len(items) > least else None

    return step


def halve_inner(path: str, inner: str, least: int = 1) -> Callable[[dict], dict | None]:
    def step(payload: dict) -> dict | None:
        items = [x | {inner: x[inner][: max(least, len(x[inner]) // 2)]} if len(x.get(inner) or []) > least else x for x in payload.get(path) or []]
        return payload | {path: items}

    return step


def drop_field(path: str, field: str) -> Callable[[dict], dict | None]:
    return lambda payload: payload | {path: [{k: v for k, v in x.items() if k != field} for x in payload.get(path) or []]}


def keep_fields(path: str, fields: list[str]) -> Callable[[dict], dict | None]:
    return lambda payload: payload | {path: [{k: v for k, v in x.items() if k in fields} for x in payload.get(path) or []]}


def first_fitting(variants: list[dict], size: Callable[[dict], int], limit: int) -> dict | None:
    return next((v for v in variants if size(v) <= limit), None)


def least_doc_chars(doc: int, configured: int, ratio: float) -> int:
    return min(doc, max(configured, int(doc * ratio)))
