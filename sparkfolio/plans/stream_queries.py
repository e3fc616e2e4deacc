"""Queries on streams, run over what is available and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.plans.registry import query, table
from sparkfolio.streaming import progress as S


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """A stream's rows, drained into the shared folder; a folder of its own is made on one machine only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="sparkfolio-stream-")
    return S.drained(stream, f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}", mode)


@query("""select time_bucket(interval '6 hours', ts, timestamp '2000-01-01') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def stream_progress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.watched_files(spark, f"{sf_dir}/events*.parquet", S.EVENTS_SCHEMA)
    out = _drained(spark, S.windowed(events, late="30 days"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select distinct md5(user_id || ':' || event_type) as fingerprint from events")
def stream_requests_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.watched_files(spark, f"{sf_dir}/events*.parquet", S.EVENTS_SCHEMA)
    asked = events.select("ts", F.md5(F.concat_ws(":", F.col("user_id").cast("string"), "event_type")).alias("fingerprint"))
    return _drained(spark, S.requests_once(asked, late="60 days"), "append").select("fingerprint")


@query("select user_id, arg_max(event_type, {'ts': ts, 'e': event_id}) as stage, count(*) as steps, max(ts) as at from events group by user_id")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stage_state(table(spark, sf_dir, "events"))
