"""Event streams: tumbling, sliding and session windows with late data, and deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialecta.tables import swap


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 4) -> DataFrame:
    """A stream over parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Events with a watermark where they stream; a time without zone is read in the session's zone there."""
    if not events.isStreaming:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, key: str, value: str, size: str, late: str) -> DataFrame:
    """(start, key, n, total) per window of fixed size; rows later than ``late`` are dropped by the watermark."""
    e = _timed(events, time, late)
    return e.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, time: str, key: str, size: str, step: str, late: str) -> DataFrame:
    """(start, key, n) per overlapping window."""
    e = _timed(events, time, late)
    return e.groupBy(F.window(time, size, step), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of bursts with no pause of ``gap`` or more."""
    e = _timed(events, time, late)
    s = e.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, id_col: str, time: str, late: str) -> DataFrame:
    """Each event once; state for an id is dropped when the watermark has passed it."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark([id_col]) if events.isStreaming else events.dropDuplicates([id_col])


def upsert_sink(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row per key in a parquet table; each batch swaps a new version in."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        every = batch.unionByName(spark.read.schema(batch.schema).parquet(path)) if fs.exists(target) else batch
        newest = every.groupBy(key).agg(F.max_by(F.struct(*every.columns), order).alias("r")).select("r.*")
        beside = f"{path}.__{epoch}"
        newest.write.mode("overwrite").parquet(beside)
        swap(fs, jvm.org.apache.hadoop.fs.Path, beside, path)

    return write


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into a table in memory; for tests and backfills."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
