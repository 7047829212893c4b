"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import shared_folder, stage

_ROW_BITS = 33  # monotonically_increasing_id(): partition number above, position in the partition below


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partition_of(mid: Column) -> Column:
    return F.shiftright(mid, _ROW_BITS)


def position_of(mid: Column) -> Column:
    return mid.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def global_index(df: DataFrame, *order: Column, name: str = "idx") -> DataFrame:
    """Gapless index from 0 over the order, without a single-task window; the result is staged.

    Rows are range-partitioned and sorted; a row's index is its position in its partition plus the rows of the
    partitions before. Only one row per partition meets in one task, and that table is what is broadcast.
    """
    rows = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    counts = rows.groupBy(partition_of(F.col("_mid")).alias("_pid")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        rows.join(F.broadcast(starts), partition_of(F.col("_mid")) == F.col("_pid"))
        .withColumn(name, F.col("_start") + position_of(F.col("_mid")))
        .drop("_mid", "_pid", "_n", "_start")
    )


def as_written(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns, also returned, by which its rows stand as they were written: part file, then row in it.

    A read deals files and parts of them out by size, so it keeps no order. Rows that come from no files stand as they
    do in the partitions.
    """
    try:
        out = df.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        out = df.select("*", F.lit("").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    return out, ["_file", "_row"]


def stage_table(df: DataFrame) -> DataFrame:
    """Write an intermediate result as Parquet to the shared folder and read it again: compressed, and pruned by column."""
    path = shared_folder(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system. Workers outlive their task, and what they keep is lost to the executor's later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def text_steps(batches: Iterator[pa.RecordBatch], size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` characters of a text column, one text at least; gives memory back after the last."""
    for b in batches:
        lens = np.cumsum(pc.fill_null(pc.utf8_length(b.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(lens, (lens[lo - 1] if lo else 0) + size, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi
        b = None
    give_back()
