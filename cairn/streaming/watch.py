"""Watching sources as streams: file changes in debounced batches, incremental state, deltas, roll-ups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import sets
from cairn.operators.graph import shared_folder
from cairn.sources.scan import decoded, skipped

DEBOUNCE = "2 seconds"


def file_stream(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """SRC-24: files as they appear or change under a root, relevant ones only."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return raw.filter(~skipped(F.col("path"), F.col("length"))).select("path", "modificationTime", "length", "content", F.sha2("content", 256).alias("hash")).transform(decoded)


def debounced(events: DataFrame, ts: str = "ts", key: str = "path", gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """ST-02: one row per quiet spell of a source: the keys of a session that ``gap`` without events ends."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.session_window("_ts", gap).alias("s")).agg(F.collect_set(key).alias("keys"), F.count("*").alias("events")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "keys", "events")


def apply_batch(state: DataFrame, batch: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """ST-03 and ST-04: the state (``key, hash``) after a batch of ``key, hash`` (null hash: deleted; of several rows of a key the one with the
    largest ``at`` counts, if there is such a column), and the batch's report."""
    at = F.struct("at", "hash") if "at" in batch.columns else F.struct("hash")
    last = batch.groupBy("key").agg(F.max(at)["hash"].alias("_new"), F.lit(True).alias("_in"))
    both = state.join(last, "key", "full")
    status = F.when(F.col("_in").isNull(), F.lit(None)).when(F.col("_new").isNull(), F.when(F.col("hash").isNotNull(), "removed")).when(F.col("hash").isNull(), "added").when(F.col("hash") != F.col("_new"), "changed")
    changes = both.select("key", status.alias("status")).filter("status is not null")
    after = both.select("key", F.when(F.col("_in"), F.col("_new")).otherwise(F.col("hash")).alias("hash")).filter("hash is not null")
    touched = sets.affected(changes, edges) if edges is not None else changes.select("key").limit(0)
    return after, sets.delta_report(changes, touched)


def watch(source: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = DEBOUNCE):
    """ST-01: run ``on_batch`` on each micro-batch; a trigger interval of the debounce time gathers what belongs together."""
    writer = source.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def watch_states(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream, in one run over what is there: each batch is applied to the state that the one before has written under
    the checkpoint folder; a batch that is run again starts from the same state."""
    base = f"{shared_folder(spark)}/cairn/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(_folder_or_glob(spark, path))
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("hash"), F.col("event_id").alias("at"))
    last = [-1]

    def step(batch: DataFrame, no: int) -> None:
        before = spark.read.parquet(f"{base}/state-{no - 1}") if no else spark.createDataFrame([], "key string, hash string")
        after, _ = apply_batch(before, batch)
        after.write.mode("overwrite").parquet(f"{base}/state-{no}")
        last[0] = no

    watch(rows, step, f"{base}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/state-{last[0]}") if last[0] >= 0 else spark.createDataFrame([], "key string, hash string")


def _folder_or_glob(spark: SparkSession, path: str) -> str:
    """A folder of files as it is; a single file as a pattern that only it matches (streams read folders or patterns)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path if fs.getFileStatus(p).isDirectory() else path[:-1] + "[" + path[-1] + "]"
