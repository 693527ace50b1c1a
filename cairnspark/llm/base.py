"""What the operators of this subpackage share: shared-folder tables, input
projection, salted group lookups and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import input_bytes

#: Rows of one hot key are spread over so many sub-keys at least before they
#: meet; a session of more shuffle partitions has as many as these.
SALTS = 64
#: ASCII white space of the word rules; bytes.split() splits at exactly these.
SPACES = r"[\x20\x09-\x0D]+"
#: Folders of our own, by application, where the cluster names none.
_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in
    ``spark.checkpoint.dir``. A folder of our own is set only where none is
    named and driver and executors are one process."""
    key, context = "spark.checkpoint.dir", spark.sparkContext
    found = spark.conf.get(key, None) or context.getConf().get(key, None) or _own.get(context.applicationId)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cairnspark-")
    return f"{found.rstrip('/')}/cairnspark/{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder, once no result
    that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends there, and a lost executor costs no more than its running tasks."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing will read it again."""
    spark, path = df.sparkSession, getattr(df, "_stored_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def released(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed now: Spark does so
    when the driver collects what refers to them, which may be much later."""
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, under names of its own, so extra or
    clashing columns of the input cannot interfere. Null texts become empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in more],
    )


def shuffle_parts(df: DataFrame, mb: int = 64) -> int:
    """Partitions for a shuffle of ``df``: the session's number, or more where
    the size of its tables would leave over ``mb`` MB in each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(input_bytes(df) // (mb << 20), 1 << 20))


def salts(spark: SparkSession) -> int:
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def clear_of(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, changed where ``names`` has them (in any case)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def salted_join(df: DataFrame, table: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """``df`` joined to ``table``, which has one row per key. Rows of a key
    are spread by the hash ``salt``; the table's row first meets the distinct
    (key, salt), then each of these its rows. Keys must not be null."""
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts(df.sparkSession))))
    spread = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def group_lookup(df: DataFrame, keys: list[str], salt: Column, aggs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``df`` with aggregates of each row's group, without gathering a group.

    ``aggs`` maps a name to (partial, final), the final over the partial's
    name. Rows join on (keys, salt), so a key that holds a third of all rows
    is spread over SALTS tasks or more; only one row per (key, salt) meets by key.
    Keys must not be null.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts(df.sparkSession))))
    part = salted.groupBy(*keys, "_salt").agg(*[p.alias(n) for n, (p, _) in aggs.items()])
    whole = part.groupBy(*keys).agg(*[f.alias(n) for n, (_, f) in aggs.items()])
    return salted.join(part.select(*keys, "_salt").join(whole, keys), [*keys, "_salt"]).drop("_salt")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys that
    come before in the order; rows that tie stand in any order. Rows are
    dealt by ranges of (keys, order), so a key of many rows is spread over
    tasks: each sums its own stretch and only the stretches' totals meet."""
    (task, own, before, total, tie) = clear_of(df.columns, "_task", "_own", "_before", "_total", "_tie")
    by, within = ", ".join(f"`{c}`" for c in [*keys, task]), ", ".join(f"`{c}`" for c in [*order, tie])
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(df), *keys, *order, tie)
    dealt = stored(dealt.withColumn(task, F.spark_partition_id()), "stretches")
    sums = dealt.groupBy(*keys, task).agg(F.sum(value).alias(total))
    past = "rows between unbounded preceding and 1 preceding"
    of_keys = ", ".join(f"`{c}`" for c in keys)
    sums = sums.select(*keys, task, F.expr(f"coalesce(sum(`{total}`) over (partition by {of_keys} order by `{task}` {past}), 0)").alias(before))
    rows = dealt.withColumn(own, F.expr(f"coalesce(sum(`{value}`) over (partition by {by} order by {within} {past}), 0)"))
    return rows.join(sums, [*keys, task]).withColumn(name, F.col(before) + F.col(own)).drop(task, own, before, tie)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the long edges (u, v); root is the
    component's smallest node, itself among the nodes.

    Alternating large-star and small-star steps; each round is one job that
    ends in a shared table, until a round leaves the edges as they were: as
    many, and none that was not there. Hubs are handled by ``group_lookup``.
    """
    low = {"m": (F.min("v"), F.min("m"))}
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    n = now.count()
    while n:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = group_lookup(both, ["u"], F.col("v"), low).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = group_lookup(large, ["u"], F.col("v"), low)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        then = stored(small, "edges")
        m = then.count()
        still = m == n and then.join(now, ["u", "v"], "left_anti").isEmpty()
        dropped(now)
        now, n = then, m
        if still:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def hash_sample(df: DataFrame, keys: list[str], k: int, seed: int) -> list:
    """At most ``k`` distinct rows of ``df``, the first in the order of a
    seeded hash of ``keys``. Rows past about twice the k-th hash are left out
    where they are read, so the driver receives about 2 k rows however many
    tasks there are; where too few are left, all rows are looked at, so the
    cut changes no result. Copies of a key are one row, merged before they
    are moved."""
    some = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    place = F.pmod("_h", F.lit(1 << 32))
    n = some.agg(F.approx_count_distinct("_h")).first()[0]
    first = lambda rows: rows.dropDuplicates(keys).orderBy(place, "_h", *keys).limit(k).drop("_h").collect()
    if n > 4 * k:
        found = first(some.where(place < int((2 * k + 50) / n * (1 << 32))))
        if len(found) == k:
            return found
    return first(some)
