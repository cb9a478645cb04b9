"""How much a Python worker is handed at once, and what it keeps between tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch: texts are long, and a worker holds a batch or two.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches from here on in this session."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def give_back() -> None:
    """Return freed memory to the system: a worker is used again, and what one task freed would stay its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
    if trim is not None:
        trim(0)
