"""Cutting lineage and finding the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (local tests) a temporary folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="cladeframe-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    Iterative plans stay short and a lost executor costs no recomputation. Unlike a
    checkpointed plan the table brings its true size, so the optimiser can decide on a
    broadcast, and no inferred constraints, which otherwise pile up from round to round.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_while(df: DataFrame, holds: Column) -> tuple[DataFrame, bool]:
    """``cut``, and whether ``holds`` is true of any row, seen while the rows are written."""
    seen = Observation()
    table = cut(df.observe(seen, F.count_if(holds).alias("n")))
    return table, seen.get["n"] > 0


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
