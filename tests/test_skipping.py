"""Files that a lookup opens: all that hold the value, and few others."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.operators import skipping


def test_files_with(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 40).select(F.concat(F.lit("v"), F.xxhash64("id").cast("string")).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), (F.col("id") % 97).cast("string"))).alias("b"))
    rows.write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    stats = skipping.file_stats(read, ["a", "b"]).cache()
    held = {}
    for r in read.select("_metadata.file_name", "a", "b").collect():
        held.setdefault(r[1], set()).add(r[0])
        held.setdefault(r[2], set()).add(r[0])
    some = [v for v in list(held)[::701] if v and v.startswith("v")]
    opened = 0
    for v in some:
        got = set(skipping.files_with(stats, "a", [v]))
        assert held[v] <= got
        opened += len(got)
    assert opened <= 2 * len(some)
    assert sum(len(skipping.files_with(stats, "a", [f"v{i}"])) for i in range(30)) <= 60
    assert set(skipping.files_with(stats, "b", ["é1", "é2", "none"])) >= held["é1"] | held["é2"]
    assert skipping.files_with(stats, "a", ["zzz"]) == []
    assert skipping.read_files(spark, "a string, b string", f"{tmp_path}/t", []).count() == 0
    ranges = skipping.file_stats(read, ["a"], filters=False)
    assert set(skipping.files_with(ranges, "a", some[:3])) >= held[some[0]] | held[some[1]]
