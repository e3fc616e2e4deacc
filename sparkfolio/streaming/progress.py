"""Streams: progress windows, requests deduplicated in flight, an inbox of jobs.

Each has a batch form of the same expression, so that both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

EVENTS_SCHEMA = ST.StructType([
    ST.StructField("event_id", ST.LongType()), ST.StructField("ts", ST.TimestampNTZType()), ST.StructField("user_id", ST.LongType()),
    ST.StructField("event_type", ST.StringType()), ST.StructField("value", ST.DoubleType()), ST.StructField("props", ST.StringType()),
])


def windowed(events: DataFrame, width: str = "6 hours", late: str | None = None) -> DataFrame:
    """Number and total of each kind of event in windows of time, with a watermark for streams.

    Times without zone are taken as the session's, as a watermark needs one.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def requests_once(requests: DataFrame, late: str | None = None) -> DataFrame:
    """Of requests with one fingerprint the first by ``ts``; in a stream the first that comes within the watermark."""
    if late is None:
        rest = [c for c in requests.columns if c not in ("fingerprint", "ts")]
        first = requests.groupBy("fingerprint").agg(F.min(F.struct("ts", *rest)).alias("r"))
        return first.select("fingerprint", "r.*").select(*requests.columns)
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """A stream's rows after all that is available now has been read, as a committed table under ``folder``.

    The state and the progress are there too, so a run that was cut off goes on
    where it was.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "complete":  # every batch is the whole result; the last one stays
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
        writer.start().awaitTermination()
    else:
        writer.format("parquet").start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def watched_files(spark: SparkSession, folder: str, schema: ST.StructType, suffix: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(suffix).load(folder)


def run_jobs(inbox: DataFrame, work: Callable[[DataFrame], DataFrame], manifest: str, checkpoint: str, available_now: bool = True):
    """Process each batch of an inbox and append its manifest rows.

    A batch that was begun before a crash is run again and its rows replaced,
    since they are kept by batch; the checkpoint knows which are done.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        done = work(batch).withColumn("status", F.lit("done"))
        done.write.mode("overwrite").parquet(f"{manifest}/epoch={epoch}")

    writer = inbox.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stage_state(events: DataFrame) -> DataFrame:
    """The last stage of each job, by time and then by event, and how many it went through."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("stage"), F.count("*").alias("steps"), F.max("ts").alias("at"))
