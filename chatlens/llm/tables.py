"""Reading the given tables and writing intermediate ones in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Text bytes that the numpy kernels take at once; a longer text is taken alone.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python stages planned from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only in local mode, where none may be named, a scratch folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="chatlens-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running tasks, not the
    stages before, and no later stage recomputes what is stored.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chatlens-llm/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches, column: int, limit: int = SLICE_BYTES):
    """The same rows in batches of at most about ``limit`` bytes in one text column."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        edge = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows] if batch.num_rows else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow binary column whose row i holds the raw bytes of ``values[bounds[i]:bounds[i+1]]``."""
    values = np.ascontiguousarray(values)
    offsets = np.ascontiguousarray(bounds.astype(np.int64) * values.itemsize)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def unpacked(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column one after another, and how many each row has."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(at) // size
