"""Parquet / CSV scans and sinks (IO1, IO3-IO8, IO13, IO14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatlens.schema import CONV, KEY


def read_parts(spark: SparkSession, paths, schema: StructType | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """IO1 / IO3 / SO2: many part files (paths or globs) as one frame; an explicit
    schema skips inference; ``columns`` prunes the scan."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    r = spark.read.option("mergeSchema", "false")
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(*paths)
    return df.select(*columns) if columns else df


def publish(df: DataFrame, path: str | None = None, mode: str = "overwrite",
            view: str | None = None, partition_by: list[str] | None = None) -> None:
    """IO4 / IO7: write Parquet (overwrite or append) and/or register a global temp view."""
    if path:
        w = df.write.mode(mode)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    if view:
        df.createOrReplaceGlobalTempView(view)


def write_csv_sample(df: DataFrame, path: str, nested: tuple = (CONV,)) -> None:
    """IO5: CSV sink; nested columns are written as JSON text."""
    out = df
    for c in nested:
        if c in df.columns:
            out = out.withColumn(c, F.to_json(F.col(c)))
    out.write.mode("overwrite").option("header", True).csv(path)


def compact(spark: SparkSession, in_paths, out_path: str, files: int | None = None,
            columns: list[str] | None = None) -> None:
    """IO6: many inputs rewritten as ``files`` output files; without a number, as
    files near ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` (a rebalance)."""
    df = read_parts(spark, in_paths, columns=columns)
    df = df.repartition(files) if files else df.hint("rebalance")
    df.write.mode("overwrite").parquet(out_path)


def split_columns(df: DataFrame, side_cols: list[str], key: str = KEY):
    """IO8: (side dataset with the key and ``side_cols``, rest without them)."""
    side = df.select(key, *side_cols)
    rest = df.drop(*side_cols)
    return side, rest


def write_split(df: DataFrame, side_cols: list[str], side_path: str, rest_path: str, key: str = KEY) -> None:
    """IO8: both parts of ``split_columns`` as Parquet tables, each keeping the key."""
    side, rest = split_columns(df, side_cols, key)
    publish(side, side_path)
    publish(rest, rest_path)


def write_keyed(df: DataFrame, path: str, key: str = KEY, partitions: int | None = None,
                bloom: bool = True) -> None:
    """IO13: range-partition and sort by the key, with a Parquet bloom filter on
    it, so a key lookup reads one row group of one file (min/max + bloom)."""
    n = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    w = df.repartitionByRange(int(n), key).sortWithinPartitions(key).write.mode("overwrite")
    if bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{key}", "true")
    w.parquet(path)


def place_after(df: DataFrame, column: str, anchor: str) -> DataFrame:
    """IO14: move ``column`` right after ``anchor``; a missing anchor is an error."""
    place = {name: (i, 0) for i, name in enumerate(df.columns)}
    place[column] = (place[anchor][0], 1)
    return df.select(*sorted(place, key=place.get))
