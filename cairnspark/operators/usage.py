"""Roll-ups of steps, tokens and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["calls", "prompt_tokens", "output_tokens", "total_tokens", "duration_sec"]


def usage_sums(usage: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """Sums with null metrics as zero."""
    return usage.groupBy(*by).agg(*[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in metrics])


def usage_rollup(usage: DataFrame, run: str = "run_id", step: str = "step", metrics: list[str] = METRICS) -> DataFrame:
    """Per step, and per run in a row of the step ``total``."""
    rolled = usage.rollup(run, step).agg(F.grouping_id().alias("_g"), *[F.sum(F.coalesce(m, F.lit(0))).alias(m) for m in metrics])
    return rolled.where("_g < 3").select(run, F.when(F.col("_g") == 1, "total").otherwise(F.col(step)).alias(step), *metrics)


def analysis_usage(steps: DataFrame, by: list[str]) -> DataFrame:
    """Of the steps of an analysis (step, prompt_tokens, output_tokens,
    prompt_chars): calls, the tokens of each kind and together, characters."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long")
    out = steps.groupBy(*by).agg(F.count_distinct("step").alias("calls"), *[total(c).alias(c) for c in ("prompt_tokens", "output_tokens", "prompt_chars")])
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("output_tokens"))


def run_durations(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg(F.sum(F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"), F.count("*").alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"))


def verdict(blocks: DataFrame, by: list[str], production: str = "production", tests: str = "generated_test") -> DataFrame:
    """Blocks (block, ok) folded: production failures first, then those of
    generated tests, else ready. A null ok is a failure."""
    bad = ~F.coalesce("ok", F.lit(False))
    folded = blocks.groupBy(*by).agg(F.bool_or(bad & (F.col("block") == production)).alias("_p"), F.bool_or(bad & (F.col("block") == tests)).alias("_t"))
    return folded.select(*by, F.when(F.col("_p"), "verification_failed").when(F.col("_t"), "generated_test_verification_failed").otherwise("ready_for_merge_review").alias("verdict"))


def all_ok(blocks: DataFrame, by: list[str]) -> DataFrame:
    return blocks.groupBy(*by).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))


def failed_codes(issues: DataFrame, by: list[str]) -> DataFrame:
    """Distinct codes of failed blocks in the order first seen (``ord``)."""
    first = issues.where(~F.coalesce("ok", F.lit(False))).groupBy(*by, "code").agg(F.min("ord").alias("ord"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: x.code).alias("codes"))


#: Lines of a duplicate that one row lists.
LINES = 1 << 16


def duplicates(rows: DataFrame, keys: list[str], line: str | None = None) -> DataFrame:
    """Keys that occur more than once, with ``n``. With ``line``, a number
    that identifies a row, their lines too: a row for each ``part``, a stretch
    of LINES numbers, so that no row grows with a key's copies. Keys that
    occur once are gone before any line is gathered."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if not line:
        return counts
    parts = rows.withColumn("part", F.expr(f"`{line}` div {LINES}"))
    some = parts.groupBy(*keys, "part").agg(F.count("*").alias("_c")).join(counts, keys).drop("_c")
    return parts.join(some, [*keys, "part"]).groupBy(*keys, "n", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def first_seen(rows: DataFrame, by: list[str], value: str, order: str, most: int | None = None) -> DataFrame:
    """(by, values): the distinct values of each group in the order first
    seen, the first ``most`` of them."""
    first = rows.groupBy(*by, value).agg(F.min(order).alias("_o"))
    if most:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_o", value))).where(F.col("_n") <= most)
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))


def runs_table(runs: DataFrame) -> DataFrame:
    """One row per run with derived flags, newest path first. ``runs``: path,
    run_id, project, ok, steps, total_tokens, generated_tests."""
    label = F.when(F.col("ok").isNull(), "unknown").when(F.col("ok"), "passed").otherwise("failed")
    return runs.select(
        "path", "run_id", "project", label.alias("status"), F.coalesce(F.aggregate("steps", F.lit(0).cast("long"), lambda a, d: a + F.coalesce(d.duration_ms, F.lit(0))), F.lit(0)).alias("duration_ms"),
        F.coalesce(F.col("total_tokens").cast("string").try_cast("bigint"), F.lit(0)).alias("total_tokens"), (F.coalesce("generated_tests", F.lit(0)) > 0).alias("had_generated_tests"),
    ).orderBy(F.desc("path"))


def filtered_runs(runs: DataFrame, project: str | None = None, status: str | None = None, text: str | None = None, columns: list[str] | None = None) -> DataFrame:
    out = runs.where(F.col("project") == project) if project else runs
    out = out.where(F.col("status") == status) if status else out
    return out.where(F.contains(F.lower(F.concat_ws(" ", *(columns or ["run_id"]))), F.lit(text.lower()))) if text else out


def project_map(symbols: DataFrame, files: int = 10, per_file: int = 12) -> DataFrame:
    """The first files by path, and of each its first symbols."""
    paths = symbols.select("file_path").distinct().orderBy("file_path").limit(files)
    order = Window.partitionBy("file_path").orderBy("start_line", "qualname")
    return symbols.where("kind <> 'module'").join(F.broadcast(paths), "file_path").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_file)
