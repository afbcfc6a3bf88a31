"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, also set as its checkpoint folder.
    Where that is unset, a local master (tests) gets a new folder and any other
    an error: executors couldn't read the driver's disk."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: Rows and bytes that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Bounds a worker's memory by the batch, however long texts and pages are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
