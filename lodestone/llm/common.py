"""What the operators of this folder share: tables, staging, batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import configure, stage

__all__ = ["WORD", "SPACE", "configure", "stage", "read", "texts", "slices", "bounded", "parts_for"]

# A word is a run of anything but these; the classes read alike in Spark, DuckDB and Python.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a null text read as empty; other columns of the input are not carried."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", bytes_each: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``bytes_each``: first row, row after the last, their bytes, their offsets.

    A text longer than that makes a run of its own. A run is a view of the batch's buffer where rows have no nulls.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(col) == 0:
        return
    bufs = col.buffers()
    offsets = np.frombuffer(bufs[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = int(np.searchsorted(offsets, offsets[at] + bytes_each, side="right")) - 1
        end = min(max(end, at + 1), len(col))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (a staged table) marked for broadcast if it has at most ``rows`` rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts_for(df: DataFrame, rows_each: int) -> int:
    """Partitions that hold about ``rows_each`` rows, at least the session's shuffle width."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_each))
