"""Keyed, idempotent loads and the run log (IO10, IO12, JN4)."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.schema import (COUNTRY, KEY, LANG, MODEL, REDACTED, STATE, TAGS,
                             TOXIC, TURN)

RUN_LOG_SCHEMA = ("id string, ran_at timestamp_ntz, rows_processed long, status string, "
                  "errors int, duration_seconds double, notes string")


def with_defaults(df: DataFrame) -> DataFrame:
    """IO10 null defaults: strings to '', turn to 0, flags to false, blank
    state to null, ``tags_text`` from the tags."""
    out = df
    for c in (MODEL, LANG, COUNTRY):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    if TURN in df.columns:
        out = out.withColumn(TURN, F.coalesce(F.col(TURN), F.lit(0)))
    for c in (REDACTED, TOXIC):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(False)))
    if STATE in df.columns:
        out = out.withColumn(STATE, F.when(F.trim(F.col(STATE)) == "", F.lit(None)).otherwise(F.col(STATE)))
    if TAGS in df.columns:
        out = out.withColumn("tags_text", F.lower(F.concat_ws(" ", F.coalesce(
            F.col(TAGS), F.array().cast("array<string>")))))
    return out


def first_wins(df: DataFrame, key: str = KEY, order_by: list[str] | None = None) -> DataFrame:
    """WN6: one row per key, the first by ``order_by``; a repeated key is
    reduced in every map task instead of being gathered in one.

    The aggregation sorts whole rows by key, in each map task and after the
    shuffle; for wide rows in files ``first_wins_parts`` sorts keys only."""
    order_by = order_by or []
    others = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_by]) if order_by else F.lit(0)
    return (df.where(F.col(key).isNotNull())
              .groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_r"))
              .select(key, "_r.*"))


def with_places(df: DataFrame) -> DataFrame:
    """Rows read from Parquet files with the file and the place that they come from, as ``_file`` and ``_row``."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def first_wins_parts(spark: SparkSession, paths, key: str = KEY, order_by: list[str] | None = None, keyed=None, schema=None) -> DataFrame:
    """WN6 / IO10 over part files, in two phases: the first row of each key.

    The first phase reduces key, order, file and place alone; the second
    fetches the winners' rows by file and place, so what else a row holds is
    read once and never sorted by key.  ``keyed`` adds a key that the files
    lack and must keep the columns it is given.  Equal orders go by file and
    place; rows without a key are dropped.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = with_places(reader.parquet(*paths))
    rows = keyed(rows) if keyed else rows
    place = F.struct("_file", "_row")
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(place, F.struct(*(order_by or []), "_file", "_row")).alias("_p"))
    return rows.join(first.select("_p.*"), ["_file", "_row"], "left_semi").drop("_file", "_row")


def new_keys(new: DataFrame, target: DataFrame, key: str = KEY) -> DataFrame:
    """JN4: rows whose key is not in the target yet (left anti join)."""
    return new.join(target.select(key), key, "left_anti")


def first_wins_load(new: DataFrame, target: DataFrame | None, key: str = KEY,
                    order_by: list[str] | None = None, defaults: bool = True) -> DataFrame:
    """IO10: rows to append so the target holds the first row of every key;
    re-running with the same input appends nothing."""
    d = with_defaults(new) if defaults else new
    d = first_wins(d, key, order_by)
    if target is not None:
        d = new_keys(d, target, key)
    return d


def log_run(spark: SparkSession, path: str, rows: int, status: str, errors: int,
            seconds: float, notes: str = "", run_id: str | None = None, mode: str = "append", note_chars: int = 500) -> None:
    """IO12: write one run-log row (duration 2 dp, notes cut to ``note_chars``), appended unless ``mode`` says otherwise."""
    import datetime
    import uuid
    row = [(run_id or uuid.uuid4().hex, datetime.datetime.now(datetime.timezone.utc).replace(microsecond=0, tzinfo=None), int(rows),
            status, int(errors), round(float(seconds), 2), (notes or "")[:note_chars])]
    spark.createDataFrame(row, RUN_LOG_SCHEMA).write.mode(mode).parquet(path)


@contextmanager
def logged_run(spark: SparkSession, path: str, notes: str = ""):
    """IO12 around a job: ``with logged_run(...) as r: r['rows'] = ...``; an
    exception is logged as an error row (message cut to 500) and re-raised."""
    t0 = time.perf_counter()
    info = {"rows": 0, "notes": notes}
    try:
        yield info
    except Exception as exc:
        log_run(spark, path, 0, "error", 1, time.perf_counter() - t0, str(exc)[:500])
        raise
    log_run(spark, path, info["rows"], "success", 0, time.perf_counter() - t0, info["notes"])
