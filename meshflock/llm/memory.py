"""Keeping Python workers small."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs run inside."""
    old = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, old)


def tidy(run):
    """``run`` over batches; its worker, which waits for further tasks, gives memory back at the end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Return freed memory to the system: the allocator keeps what large arrays leave behind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
