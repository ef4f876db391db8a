"""Process only inputs that have no result yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def incremental_ingest(
    spark: SparkSession, source: str, target: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame], schema: str, fmt: str = "parquet", files_per_trigger: int = 10000,
    suffix: str = "*",
) -> None:
    """Take up files new since the last call, write their results as Parquet, and stop.

    The checkpoint remembers the files, so a crash neither loses nor repeats one.
    """
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", suffix).format(fmt).load(source)
    )
    query = (
        transform(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def pending_inputs(inputs: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Batch form: inputs without a row in the result table."""
    return inputs.join(done.select(F.col(on)).distinct(), on, "left_anti")
