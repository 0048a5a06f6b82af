"""A secondary index of a Parquet table: key -> file and row (IO13, FL8).

For tables that keep an order of their own, such as time, and so can't be
sorted by key.  The index is partitioned by the key's hash, in as many
partitions as its rows need; a look-up reads one of them, then only the files
it names, and of those only the row groups whose bloom filter or dictionary
holds the key.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.schema import KEY
from chatlens.sources.footers import footers


def write_in_groups(df: DataFrame, path: str, key: str = KEY, group_rows: int = 100_000) -> None:
    """Write in the rows' own order, in row groups of ``group_rows`` rows that can be skipped by key."""
    (df.write.mode("overwrite").option("parquet.block.row.count.limit", group_rows)
       .option(f"parquet.bloom.filter.enabled#{key}", "true")
       .option(f"parquet.bloom.filter.expected.ndv#{key}", group_rows).parquet(path))


def positions(spark: SparkSession, path: str, key: str = KEY) -> DataFrame:
    """``(key, file, row, row_group)`` of every row: its place in its file, and the row group that holds it."""
    rows = spark.read.parquet(path).select(key, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    groups = footers(spark, [path]).select(_uri("file").alias("name"), F.transform("row_groups", lambda g: g["first"]).alias("firsts"))
    # a row group holds the rows from its first on: as many groups start at or before the row
    placed = rows.withColumn("name", _uri("file")).join(groups, "name")
    return placed.select(key, "file", "row", (F.size(F.filter("firsts", lambda first: first <= F.col("row"))) - 1).alias("row_group"))


def _uri(path: str):
    """One form for a path that is written with one, two or three slashes, and with or without escapes."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), "^([a-z0-9]+):/+", "$1:/")


def write_index(spark: SparkSession, path: str, index_path: str, key: str = KEY, bucket_rows: int = 1_000_000) -> None:
    """Store the index of the table at ``path``; written anew when the table's files change."""
    rows = footers(spark, [path]).agg(F.sum(F.aggregate("row_groups", F.lit(0).cast("long"), lambda n, g: n + g["rows"]))).first()[0] or 0
    buckets = max(1, -(-rows // bucket_rows))
    kept = positions(spark, path, key).withColumns({"buckets": F.lit(buckets), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
    (kept.repartition(buckets, "bucket").sortWithinPartitions("bucket", key)
         .write.mode("overwrite").partitionBy("buckets", "bucket").parquet(index_path))


def in_index(spark: SparkSession, index_path: str, keys: list, key: str = KEY) -> DataFrame:
    """``(key, file, row, row_group)`` of ``keys``; reads only the partitions that they hash to."""
    index = spark.read.parquet(index_path)
    kind = index.schema[key].dataType
    buckets = [F.pmod(F.xxhash64(F.lit(k).cast(kind)), F.col("buckets")) for k in keys]
    return index.where(F.col("bucket").isin(*buckets) & F.col(key).isin(list(keys))).select(key, "file", "row", "row_group")


def look_up(spark: SparkSession, path: str, index_path: str, keys: list, key: str = KEY) -> DataFrame:
    """The rows of the table at ``path`` whose key is in ``keys`` (a request's few), in full.

    Keys that the index doesn't have give no rows; a key with several rows gives all.
    """
    files = sorted(unquote(r["file"]) for r in in_index(spark, index_path, keys, key).select("file").distinct().collect())  # at most as many as rows asked for
    table = spark.read.option("basePath", path)
    if not files:
        return table.parquet(path).limit(0)
    return table.parquet(*files).where(F.col(key).isin(list(keys)))
