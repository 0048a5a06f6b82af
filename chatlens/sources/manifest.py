"""Parquet tables with a manifest of their live files: copy-on-write deletes (SD5).

``path/data`` has the files, each written once; ``path/manifest/version=N`` lists
the files of a version.  A delete rewrites only the files that hold a deleted
row and then adds a version, so readers see the table before or after it, and a
run that fails halfway changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _file() -> Column:
    return F.substring_index("_metadata.file_path", "/data/", -1).alias("file")


def _added(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as new files; ``(file, rows)`` of those with rows."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder).groupBy(_file()).agg(F.count("*").alias("rows"))


def _commit(files: DataFrame, path: str, version: int) -> None:
    """A version's folder; it must not be there yet, so of two writers one fails.

    A row without a file stands for the version itself, which may have no files.
    """
    itself = files.sparkSession.createDataFrame([(None, 0)], "file string, rows long")
    files.select("file", "rows").unionByName(itself).coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")


def create(df: DataFrame, path: str) -> None:
    """Write a new table; its file layout is that of ``df``'s partitions."""
    _commit(_added(df, path), path, 0)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``(version, file, rows)`` of all versions, with one row without a file each."""
    return spark.read.schema("file string, rows long, version int").parquet(f"{path}/manifest").select("version", "file", "rows")


def latest_version(spark: SparkSession, path: str) -> int:
    return versions(spark, path).agg(F.max("version")).first()[0]


def live_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(file, rows)`` of a version, the latest unless given."""
    at = latest_version(spark, path) if version is None else version
    return versions(spark, path).where((F.col("version") == at) & F.col("file").isNotNull()).select("file", "rows")


def _read_files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/data").limit(0)
    return spark.read.parquet(*[f"{path}/data/{n}" for n in sorted(names)])


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's rows; the driver holds the names of its files, as for any scan."""
    return _read_files(spark, path, [r["file"] for r in live_files(spark, path, version).collect()])


def delete_rows(spark: SparkSession, path: str, condition: Column) -> int:
    """Delete the rows for which ``condition`` is true; returns how many.

    Files without such a row are neither read whole (the condition is pushed
    into the scan) nor written.  Without any such row there is no new version.
    """
    at = latest_version(spark, path)
    live = live_files(spark, path, at)
    hit = read(spark, path, at).where(condition).groupBy(_file()).agg(F.count("*").alias("gone")).collect()  # a row a touched file
    if not hit:
        return 0
    touched = [r["file"] for r in hit]
    kept = _added(_read_files(spark, path, touched).where(~F.coalesce(condition, F.lit(False))), path)
    names = spark.createDataFrame([(f,) for f in touched], "file string")
    _commit(live.join(names, "file", "left_anti").unionByName(kept), path, at + 1)
    return sum(r["gone"] for r in hit)


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the files that the latest version doesn't list, and the older versions; returns how many files went.

    Only then is a deleted row gone from the disk.
    """
    at = latest_version(spark, path)
    old = versions(spark, path).where((F.col("version") < at) & F.col("file").isNotNull()).select("file").distinct()
    gone = [r["file"] for r in old.join(live_files(spark, path, at), "file", "left_anti").collect()]  # replaced files
    before = [r["version"] for r in versions(spark, path).where(F.col("version") < at).select("version").distinct().collect()]
    jvm = spark._jvm.org.apache.hadoop.fs
    store = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [f"data/{n}" for n in gone] + [f"manifest/version={v}" for v in before]:
        store.delete(jvm.Path(f"{path}/{name}"), True)
    return len(gone)
