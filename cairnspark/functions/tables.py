"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application, where the cluster names none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only
    where none is named and driver and executors are one process."""
    key, context = "spark.checkpoint.dir", spark.sparkContext
    found = spark.conf.get(key, None) or context.getConf().get(key, None) or _own.get(context.applicationId)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cairnspark-")
    return f"{found.rstrip('/')}/cairnspark/{context.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its
    lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
