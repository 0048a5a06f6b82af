"""Parquet footers read by tasks: schemas and row groups of many files (IO2, IO13).

The files are listed as a table by Spark; each task opens the footers of its
own files and sends a row a file.  No file's schema is inferred on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

#: Stores whose footers a task can seek to; from any other, Spark hands over whole files.
SEEKABLE = {"": "", "file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}
#: Where a Spark writer keeps a file's own schema.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
FOOTER = "file string, columns array<struct<name:string,type:string>>, row_groups array<struct<first:long,rows:long,bytes:long>>"


def listing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, length, content)`` of every Parquet file under ``paths``; what isn't selected isn't read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
            .load(paths).select("path", "length", "content"))


def _opened(path: str, content: bytes | None) -> pq.ParquetFile:
    if content is not None:
        return pq.ParquetFile(pa.BufferReader(content))
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pq.ParquetFile("/" + rest.lstrip("/"))
    store, at = pyarrow.fs.FileSystem.from_uri(f"{SEEKABLE[scheme]}:{rest}")
    return pq.ParquetFile(store.open_input_file(at))


def _types(file: pq.ParquetFile) -> list[dict]:
    own = (file.metadata.metadata or {}).get(SPARK_SCHEMA)
    if own:
        return [{"name": f.name, "type": f.dataType.simpleString()} for f in StructType.fromJson(json.loads(own)).fields]
    out = []
    for f in file.schema_arrow:
        try:
            kind = from_arrow_type(f.type, prefer_timestamp_ntz=True).simpleString()
        except Exception:  # a type Spark has no name for
            kind = str(f.type)
        out.append({"name": f.name, "type": kind})
    return out


def footers(spark: SparkSession, paths: list[str], whole: bool | None = None) -> DataFrame:
    """``(file, columns, row_groups)`` of every Parquet file under ``paths``.

    ``whole`` reads files through Spark from their first byte to the last, for
    stores that only Spark opens; without it the store's name decides.
    """
    if whole is None:
        whole = urlparse(paths[0]).scheme not in SEEKABLE
    files = listing(spark, paths).select("path", F.col("content") if whole else F.lit(None).cast("binary").alias("content"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = _opened(path, content.as_py())
                groups, first = [], 0
                for i in range(file.metadata.num_row_groups):
                    g = file.metadata.row_group(i)
                    groups.append({"first": first, "rows": g.num_rows, "bytes": g.total_byte_size})
                    first += g.num_rows
                yield pa.RecordBatch.from_pylist([{"file": path, "columns": _types(file), "row_groups": groups}], pa.schema([
                    ("file", pa.string()), ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
                    ("row_groups", pa.list_(pa.struct([("first", pa.int64()), ("rows", pa.int64()), ("bytes", pa.int64())])))]))

    return files.mapInArrow(read, FOOTER)


def schema_report(spark: SparkSession, paths: list[str], whole: bool | None = None) -> DataFrame:
    """IO2: compare every file's schema with that of the first file of the first path.

    ``(path, column, expected, actual, files)``: the given path, the column, both
    types, and how many files under the path differ so.  A column that a file
    lacks has no actual type, one it has on top no expected one; a file that
    differs in nothing but the order of columns gives one row with a null
    column and both orders.  Empty means consistent.
    """
    found = footers(spark, paths, whole)
    first = footers(spark, paths[:1], whole).agg(F.min_by("columns", "file")).scalar()
    names = F.array_distinct(F.concat(F.transform("columns", lambda c: c["name"]), F.transform("_first", lambda c: c["name"])))

    def type_in(columns: str, name):
        return F.get(F.filter(columns, lambda c: c["name"] == name), F.lit(0))["type"]

    different = found.withColumn("_first", first).where(F.col("columns") != F.col("_first"))  # one fingerprint: the whole list
    changes = F.filter(F.transform(names, lambda n: F.struct(n.alias("column"), type_in("_first", n).alias("expected"), type_in("columns", n).alias("actual"))),
                       lambda c: ~c["expected"].eqNullSafe(c["actual"]))
    order = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.array_join(F.transform("_first", lambda c: c["name"]), ",").alias("expected"),
                             F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("actual")))
    rows = different.select("file", F.explode_outer(F.when(F.size(changes) > 0, changes).otherwise(order)).alias("c")).select("file", "c.*")
    # a file belongs to the given path that it is, or lies in
    given = spark.createDataFrame([(p, _qualified(spark, p)) for p in dict.fromkeys(paths)], "path string, root string")
    steps = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    placed = rows.withColumn("root", F.explode_outer(above)).join(given, "root")
    return placed.groupBy("path", "column", "expected", "actual").agg(F.countDistinct("file").alias("files"))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's listing writes it; a name only, nothing is opened."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
