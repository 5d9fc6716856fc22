"""Helpers shared by the training-data operators.

Every operator takes DataFrames with at least ``doc_id`` and ``text``; further
columns are ignored, whatever their names, because each operator selects what
it needs first.  ``doc_id`` may repeat or be null unless an operator says
otherwise; a null text counts as the empty text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import Scratch, fresh_path, materialise, register, remove, shared_dir  # noqa: F401

#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches; a worker gives free memory back after each task, since it outlives the task.

    Batches hold at most ``BATCH_ROWS`` rows, and ``BATCH_BYTES`` bytes or one
    row, so what a worker holds is bounded.  Spark reads both limits from the
    session when a frame is run, not when it is made, so the session keeps
    them; a session with smaller limits of its own keeps those.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def width(df: DataFrame) -> int:
    """Partitions for a shuffle of whole texts: as many as the scan has, or more if the session says so."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def bounded_sample(df: DataFrame, rows: int, salt: str) -> DataFrame:
    """About ``rows`` rows at most, the same ones on every run: those whose hashed doc_id is small enough."""
    n = df.count()
    if n <= rows:
        return df
    top = int(rows / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) < top)
