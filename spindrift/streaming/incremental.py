"""A watched folder: new files flow through the cache rule into the next version of the track table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import AUDIO_EXTENSIONS, extension
from ..operators import cache


def watch(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream of new audio files; at most ``max_files`` per batch are in flight. Changed files need the batch rescan: the file source knows paths only."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return raw.select(path.alias("filepath"), F.col("length").alias("filesize"), F.col("modificationTime").alias("modified")).filter(extension("filepath").isin(*AUDIO_EXTENSIONS) & (F.col("filesize") > 0))


def upsert_stream(rows: DataFrame, root: str, read: Callable[[], DataFrame], checkpoint: str):
    """Write the rows of each micro-batch as a delta of their own; the batch number names it, so a replayed batch is not added twice.

    ``current`` puts base and deltas together and ``compact`` rewrites the base, so a batch costs its own rows and not the table. Rows may lack columns of
    the table (a listing has no tags); ``last_scanned`` is the time of the batch where they have none. Existence is asked of the file system that ``root`` names.
    """
    base = read().schema

    def one(batch: DataFrame, number: int) -> None:
        path = f"{root}/delta-{number:08d}"
        if exists(batch.sparkSession, f"{path}/_SUCCESS"):
            return
        cache.fitted(batch, base).write.mode("overwrite").parquet(path)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current(spark: SparkSession, base: DataFrame, root: str, batches: int) -> DataFrame:
    """The table after so many micro-batches: the base with all deltas upserted, the latest scan of a path last."""
    paths = [p for n in range(batches) if exists(spark, f"{(p := f'{root}/delta-{n:08d}')}/_SUCCESS")]
    return cache.upsert(base, spark.read.schema(base.schema).parquet(*paths)) if paths else base


def compact(spark: SparkSession, base: DataFrame, root: str, batches: int, version: int) -> str:
    return cache.write_version(current(spark, base, root, batches), root, version)


def batches_done(query) -> list[dict]:
    """What a stream has done so far: batch, rows, seconds and rows per second of each recent micro-batch. It is paused by ``query.stop()`` and goes on from its checkpoint."""
    out = []
    for p in query.recentProgress:
        seconds = p["durationMs"].get("triggerExecution", 0) / 1000.0
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "seconds": seconds, "rows_per_second": p["numInputRows"] / seconds if seconds else 0.0})
    return out


def moving_speed(samples: DataFrame, last: int = 10) -> DataFrame:
    """Average of the last samples per series: series, ts, value."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("series").orderBy("ts", "event").rowsBetween(-(last - 1), 0)
    return samples.withColumn("average", F.avg("value").over(w))
