"""Streams over growing tables: incremental loads and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.sinks import VersionedTable, hadoop_path


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:  # noqa: ANN001
    """Parquet files as they arrive in a folder, or under the one name of a file."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    fs, p = hadoop_path(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def upsert_stream(stream: DataFrame, target: VersionedTable, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):  # noqa: ANN201
    """Put each batch of a stream into a keyed table; a batch that is run again changes nothing. Runs until what is there is taken."""

    def batch(frame: DataFrame, _: int) -> None:
        t = prepare(frame) if prepare else frame
        if not t.isEmpty():
            target.upsert(t, key)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, by..., n, total: counts and sums of ``value`` by window; on a stream, events later than ``late`` are dropped."""
    t = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return t.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """start, end, by, n: sessions that end after a gap without events."""
    t = events.withWatermark(time, late) if events.isStreaming else events
    return t.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a stream over all that is there and keep the result of the last batch (complete mode) or all batches (append mode)."""

    def batch(frame: DataFrame, _: int) -> None:
        frame.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
