"""Incremental ingest as Structured Streaming jobs.

* ST1/ST2/ST5 ``stream_first_wins``: new part files -> first row of each key that
  no earlier batch brought -> (optional tagging) -> a Parquet table, one run-log
  row per micro-batch.  What keys were seen is streaming state, so a batch reads
  its own files and never the target.
* ST3 ``dedupe_stream``: duplicate keys dropped within the watermark (state
  bounded by the watermark delay).
* ST4 ``event_time_counts``: tumbling event-time windows with a watermark; rows
  later than the watermark are dropped.  ``stream_window_counts`` keeps every
  window's latest count, the windows still open included.

A batch writes into a folder of its own number, so a replayed one overwrites
what it wrote before; a reader sees the number as the column ``load_batch``.
"""

from __future__ import annotations

import hashlib
import time
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatlens.operators.ingest import log_run
from chatlens.schema import KEY

PLACE = ["_file", "_row"]


def _placed(df: DataFrame) -> DataFrame:
    """Each row with its file and its place there."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def first_places(rows: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """A stream of ``(key, _first, _since, _last)``: where the first row of each key lies, and when the key came first and last.

    First is the earliest batch, then ``order_by``, file and place.  The batch
    time is one value for all rows of a batch, also when it is replayed; a key
    is new in the batch in which ``_since`` equals ``_last``.  The state has a
    row a key and none of the payload.
    """
    timed = rows.where(F.col(key).isNotNull()).withColumn("_at", F.current_timestamp())
    order = F.struct("_at", *order_by, *PLACE)
    return timed.groupBy(key).agg(F.min_by(F.struct(*PLACE), order).alias("_first"), F.min("_at").alias("_since"), F.max("_at").alias("_last"))


def stream_first_wins(spark: SparkSession, in_dir: str, target: str, checkpoint: str,
                      schema: StructType, key: str = KEY, order_by: list[str] | None = None,
                      keyed=None, transform=None, run_log: str | None = None,
                      max_files_per_trigger: int | None = None, available_now: bool = True):
    """ST1 (+ST2 via ``transform``, +ST5 via ``run_log``); returns the started query.

    ``keyed`` adds the key and order columns that the files lack; it must keep
    the columns it is given.  ``transform`` shapes the rows that are kept, and
    them alone.  A batch runs in two phases: keys and order alone go through
    the state, then the winners' rows are fetched by file and place from the
    files of the batch.  Rows without a key are dropped.
    """
    keyed = keyed or (lambda df: df)
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    first = first_places(keyed(_placed(r.parquet(in_dir))), key, order_by or [])

    def batch(df: DataFrame, batch_id: int) -> None:
        t0 = time.perf_counter()
        sess = df.sparkSession
        new = df.where("_since = _last").select("_first.*").persist()
        try:
            files = sorted(unquote(r["_file"]) for r in new.select("_file").distinct().collect())  # files of this batch
            n = new.count()
            if files:
                rows = keyed(_placed(sess.read.schema(schema).parquet(*files)).join(new, PLACE, "left_semi"))
                rows = (transform(rows) if transform else rows).drop(*PLACE)
                rows.write.mode("overwrite").parquet(f"{target}/load_batch={batch_id}")
        finally:
            new.unpersist()
        if run_log:
            stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
            log_run(sess, f"{run_log}/stream={stream}/load_batch={batch_id}", n, "success", 0, time.perf_counter() - t0,
                    f"micro-batch {batch_id}", run_id=f"{checkpoint}#{batch_id}", mode="overwrite")

    w = first.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; naive times are read as UTC (the session zone)."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def dedupe_stream(df: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """ST3: drop repeated keys that arrive within the watermark delay."""
    return _event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def event_time_counts(df: DataFrame, ts: str, dims: list[str], size: str = "1 hour",
                      delay: str = "10 minutes") -> DataFrame:
    """ST4: counts per tumbling window and dimension; append mode emits a
    window once the watermark passes its end."""
    return (_event_time(df, ts).withWatermark(ts, delay)
              .groupBy(F.window(ts, size).alias("w"), *dims)
              .agg(F.count(F.lit(1)).alias("count"))
              .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), *dims, "count"))


def stream_window_counts(df: DataFrame, ts: str, dims: list[str], target: str, checkpoint: str, size: str = "1 hour",
                         delay: str = "10 minutes", available_now: bool = True):
    """ST4 with every window: each batch writes the counts that it changed; returns the started query.

    ``window_counts`` reads the latest of each window, so the last windows are
    there while they are open, and a later run goes on counting them.  The
    watermark bounds the state as in append mode.
    """

    def batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/load_batch={batch_id}")

    w = event_time_counts(df, ts, dims, size, delay).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def window_counts(spark: SparkSession, target: str, dims: list[str]) -> DataFrame:
    """``(window_start, window_end, dims, count)`` as of the last batch."""
    return spark.read.parquet(target).groupBy("window_start", "window_end", *dims).agg(F.max_by("count", "load_batch").alias("count"))
