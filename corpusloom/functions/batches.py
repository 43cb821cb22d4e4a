"""Bounds on what Python workers hold: small Arrow batches, and memory handed back after a task."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 4_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session gives Python no Arrow batches above ``BATCH_BYTES`` from now on (but for single rows that are larger)."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = int("".join(c for c in (conf.get(key, None) or "0") if c.isdigit()) or 0)
    if not 0 < held <= BATCH_BYTES:
        conf.set(key, BATCH_BYTES)
    return df


def hand_back() -> None:
    """Give freed memory back to the system: a worker stays for later tasks, which may be others."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
