"""What goes to a Python worker at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

#: What a batch of rows that goes to a Python worker holds at most, if the session has no lower bounds.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, which otherwise hold 10,000 rows of any length."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def lean_worker() -> None:
    """In a Python worker: freed Arrow memory goes back to the system, because the worker outlives its task."""
    pa.set_memory_pool(pa.system_memory_pool())
