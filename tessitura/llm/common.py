"""Shared folder, written tables, batch slicing and small column helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one set earlier on the context.

    Where neither is set, a session in one process (master ``local``) gets a temporary folder; any other
    raises, for a machine-local folder would lose data on a cluster.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        named = context.getCheckpointDir()
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared one; the file system removes it when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context.hadoopConfiguration()).deleteOnExit(path)
    return folder


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Writes ``frame`` to the shared folder and reads it back: later steps reuse it and no executor's loss costs it."""
    folder = scratch(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the plain ``lower`` does it where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def same_row(left: Column, right: Column) -> Column:
    """Null-safe equality, for keys that may be null."""
    return left.eqNullSafe(right)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``size`` bytes of ``column``; one longer text is a run of its own."""
    at = batch.schema.get_field_index(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > size:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column one after another, and the offset of each text; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
