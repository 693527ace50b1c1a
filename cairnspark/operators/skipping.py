"""File skipping: what each data file of a folder holds of the columns that
lookups go by, so that a lookup opens only the files that may match.

Of each file and column there is the range of its values and a Bloom filter
in blocks of 32,768 bits, ten bits a distinct value: a value belongs to one
block and sets ``HASHES`` bits there. A file without a value is opened in
about one of a hundred lookups; one with it always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a block, as the bitmap functions have it, set a value, and bits a value.
BLOCK_BITS, HASHES, BITS_A_VALUE = 32_768, 5, 10
SCHEMA = "file string, column string, low string, high string, blocks int, block int, bits binary"


def _positions(value: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(s), value), F.lit(BLOCK_BITS)) for s in range(HASHES)])


def _block(value: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), value), blocks).cast("int")


def file_stats(rows: DataFrame, columns: list[str], filters: bool = True) -> DataFrame:
    """(file, column, low, high, blocks, block, bits) of ``rows``, read from
    a flat folder. Columns are strings; nulls are not looked up. Without
    ``filters`` there are only ranges."""
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    values = rows.select(F.col("_metadata.file_name").alias("file"), F.explode(named).alias("c")).select("file", "c.column", "c.value").where("value is not null")
    values = values.distinct() if filters else values
    ranges = values.groupBy("file", "column").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.ceil(F.count("*") * F.lit(BITS_A_VALUE) / BLOCK_BITS).cast("int").alias("blocks"))
    if not filters:
        return ranges.select("file", "column", "low", "high", F.lit(0).alias("blocks"), F.lit(0).alias("block"), F.lit(None).cast("binary").alias("bits"))
    each = values.join(ranges, ["file", "column"]).select("file", "column", "low", "high", "blocks", _block(F.col("value"), F.col("blocks")).alias("block"), F.explode(_positions(F.col("value"))).alias("at"))
    return each.groupBy("file", "column", "low", "high", "blocks", "block").agg(F.bitmap_construct_agg("at").alias("bits"))


def files_with(stats: DataFrame, column: str, values: list[str]) -> list[str]:
    """The files that may hold any of a few stated values."""
    of = stats.where(F.col("column") == column).withColumn("value", F.explode(F.array(*[F.lit(v) for v in values])))
    near = of.where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
    byte = lambda p: F.conv(F.hex(F.substring(F.col("bits"), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.forall(_positions(F.col("value")), lambda p: F.getbit(byte(p), (p % 8).cast("int")) == 1)
    near = near.where(F.col("bits").isNull() | ((F.col("block") == _block(F.col("value"), F.col("blocks"))) & set_))
    return sorted(r[0] for r in near.select("file").distinct().collect())


def read_files(spark: SparkSession, schema: str, folder: str, files: list[str]) -> DataFrame:
    """The rows of some files of a folder."""
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{f}" for f in files])
