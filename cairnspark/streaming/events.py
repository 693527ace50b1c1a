"""Streams: watermarked windows, sessions, deduplication and an incremental
index that follows a folder of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tables import stored
from ..operators import diff
from ..operators.store import Store
from ..sources import code

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def reindexed(store: Store, project: str, files: DataFrame) -> None:
    """Extract some files (file_path, file_hash, module_name, content) again
    and put what is found in place of what the index has of them."""
    mark = F.lit(project).alias("project_root")
    facts = code.facts(files).persist()
    store.replace_files(project, files.select(mark, "file_path", "file_hash", "module_name"), code.symbols(facts).select(mark, "*"), code.relations(facts).select(mark, "*"))
    facts.unpersist()


def index_changes(spark: SparkSession, folder: str, store: Store, project: str, checkpoint: str) -> StreamingQuery:
    """Keep a project's index in step with files that arrive in ``folder``.
    A batch replaces the files it names, whatever it replaces, so a batch
    that is run again after a failure leaves the same tables."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    base = folder.rstrip("/") + "/"

    def apply(batch: DataFrame, _: int) -> None:
        rel = F.replace(F.regexp_replace("path", r"^file:/*", "/"), F.lit(base), F.lit(""))
        newest = batch.groupBy("path").agg(F.max_by("content", "modificationTime").alias("content")).select(rel.alias("file_path"), F.sha2("content", 256).alias("file_hash"), "content")
        scan = newest.withColumn("module_name", code.module_name(F.col("file_path")))
        changed = scan.join(store.known_files(project), ["file_path", "file_hash"], "left_anti").persist()
        if not changed.isEmpty():
            reindexed(store, project, changed)
        changed.unpersist()

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def swept(spark: SparkSession, folder: str, store: Store, project: str) -> dict[str, int]:
    """Bring a project's index in step with a folder as it stands now. The
    store's files are the state: what they list and the folder lacks is
    deleted with its symbols and relations, what is new or differs is
    extracted. A sweep that is run again leaves the same tables."""
    scan = code.scan(spark, folder)
    states = stored(diff.status(store.known_files(project), scan.select("file_path", "file_hash"), ["file_path"], "file_hash").where("status <> 'unchanged'"), "states")
    gone = states.where("status = 'deleted'").select(F.lit(project).alias("project_root"), "file_path")
    fresh = states.where("status <> 'deleted'").select("file_path")
    counts = {r["status"]: r["count"] for r in states.groupBy("status").count().collect()}

    def apply() -> None:
        if counts.get("deleted"):
            store.delete_files(gone)
        if sum(counts.values()) > counts.get("deleted", 0):
            reindexed(store, project, scan.join(fresh, "file_path", "left_semi"))

    store.change(apply)
    return counts


def follow(spark: SparkSession, folder: str, store: Store, project: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Sweep a folder at each tick, so that files that vanish leave the index
    too, which a stream of arriving files never sees. A tick that is played
    again after a failure finds nothing to do."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, _: swept(spark, folder, store, project)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
