"""How much one Arrow batch may hand to a Python worker."""

from __future__ import annotations

from pyspark.sql import SparkSession


def bounded_batches(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Limit what one Arrow batch hands to a Python worker; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def small_batches(spark: SparkSession) -> None:
    """Batches for rows of any length: many short ones, few long ones, so a worker's memory does not follow its partition."""
    bounded_batches(spark, 1024, "4m")
