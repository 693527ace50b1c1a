"""Meeting of texts by substrings, without pairing them.

Every needle is entered under the rarest of its runs of three letters, every
hay under all of its own; equal runs meet and ``contains`` decides. Needles
of one or two letters are runs themselves. So the work follows the runs that
are shared, not hays times needles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored

#: Letters of a run.
Q = 3
#: A table of at most so many rows and bytes is sent to all tasks; a larger
#: one is shuffled.
SENT_ROWS, SENT_BYTES = 100_000, 32 << 20
#: Parts that the rows of a frequent key are spread over where both sides are
#: large, and the rows that make a key frequent at least.
SALTS, HOT_ROWS = 32, 10_000


def runs(c: Column | str, size: int = Q) -> Column:
    """Distinct runs of ``size`` letters; none of a shorter text."""
    c = F.col(c) if isinstance(c, str) else c
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1)))
    return F.when(F.length(c) < size, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))))


def small(df: DataFrame, rows: int = SENT_ROWS, size: int = SENT_BYTES) -> bool:
    """Whether a stored table may be sent to all tasks."""
    texts = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(texts, F.lit(0)).cast("long")), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] + 16 * len(df.columns) * found["n"] <= size


def key_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows to a stored table on one column. The table is
    sent to all tasks where its size allows; else both are shuffled, and rows
    of keys that hold more than a thousandth of all rows are spread: the
    table's rows of these few keys go to each part."""
    if small(right):
        return left.join(F.broadcast(right), key)
    counts = stored(left.groupBy(key).agg(F.count("*").alias("_n")), "key_counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") > max(HOT_ROWS, total // 1000)).select(key, F.lit(True).alias("_hot")))  # fewer than 1,000 rows
    spread_over = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    salted = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), spread_over).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    table = right.join(hot, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    # the planner does not know that the parts multiply its rows and might send them to all tasks
    return salted.join(table.hint("merge"), [key, "_salt"]).drop("_salt")


def contained(hays: DataFrame, needles: DataFrame) -> DataFrame:
    """(hay, needle): every distinct needle within every distinct hay that
    holds it. ``hays`` has the column hay, ``needles`` needle. Nulls match
    nothing; the empty needle is in every hay."""
    wanted = stored(needles.select("needle").where("needle is not null").distinct().withColumn("size", F.least(F.length("needle"), F.lit(Q)).cast("int")), "needles")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())
    found = stored(hays.select("hay").where("hay is not null").distinct(), "hays")
    out = found.withColumn("needle", F.lit("")) if 0 in sizes else None
    lengths = [s for s in sizes if s]
    if lengths:
        shown = found.select("hay", F.explode(F.concat(*[runs("hay", s) for s in lengths])).alias("run"))
        entries = wanted.where("size > 0").select("needle", F.explode(F.when(F.col("size") < Q, F.array("needle")).otherwise(runs("needle"))).alias("run"))
        asked = stored(entries.select("run").distinct(), "runs")
        often = key_join(shown.select("run"), asked, "run").groupBy("run").agg(F.count("*").alias("n"))
        # a needle with a run that no hay has is in none of them
        rarest = entries.join(often, "run", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r"))
        rarest = stored(rarest.where("r.n > 0").select("needle", "r.run"), "rarest")
        met = key_join(shown, rarest, "run").where(F.contains("hay", F.col("needle"))).select("hay", "needle")
        out = met if out is None else out.unionByName(met)
    return out if out is not None else found.select("hay", F.col("hay").alias("needle")).limit(0)
