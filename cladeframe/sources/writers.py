"""Sinks in the formats that downstream tools read."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cladeframe.sources.wide import folder_of, write_wide


def write_fasta_groups(contigs: DataFrame, path: str, width: int = 80) -> None:
    """One FASTA folder per genome (genome, contig, seq) with lines of ``width`` letters.

    Rebalancing keeps small genomes in one file and splits a very large one.
    """
    body = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    rows = contigs.select("genome", F.concat(F.lit(">"), F.col("contig").cast("string"), F.lit("\n"), body).alias("value"))
    rows.hint("rebalance", "genome").write.partitionBy("genome").text(path)


def select_contigs(labels: DataFrame, contigs: DataFrame, wanted: Sequence[str], statuses: DataFrame | None = None) -> DataFrame:
    """Contigs carrying one of the labels, where given only in genomes of ``statuses`` (genome)."""
    keep = labels.filter(F.col("label").isin(*wanted)).select("genome", "contig")
    out = contigs.join(keep, ["genome", "contig"], "left_semi")
    return out.join(statuses.select("genome"), "genome", "left_semi") if statuses is not None else out


def write_presence_matrix(cells: DataFrame, roster: DataFrame, path: str, by: str | None = None) -> None:
    """Features as rows, genomes as columns, first header ``Gene``; with ``by`` one folder per feature class."""
    kept = [by] if by else []
    named = cells.select(F.col("feature").alias("row"), F.col("sample").alias("col"), F.lit("1").alias("value"), *kept)
    write_wide(named, cells.select(F.col("feature").alias("row")), roster.select(F.col("sample").alias("col")), path, "Gene", "0", folder_of(by, F.col(by)) if by else None)


def write_cluster_lists(members: DataFrame, path: str, min_size: int = 3, base: str = "set") -> None:
    """Member list per cluster of at least ``min_size`` strains, and an index of the lists.

    ``members`` has strain, cluster (a number) and size.
    """
    used = members.filter(F.col("size") >= min_size).withColumn("list", F.format_string("%03d", "cluster"))
    used.select("list", F.col("strain").cast("string").alias("value")).hint("rebalance", "list").write.partitionBy(
        "list"
    ).text(os.path.join(path, "lists"))
    used.select(F.concat(F.lit(f"{base}_cf_"), F.col("list")).alias("value")).distinct().write.text(os.path.join(path, "index"))


def write_distance_matrix(distances: DataFrame, tips: DataFrame, path: str, a: str = "tip_a", b: str = "tip_b", value: str = "distance") -> None:
    """Square table with one row and one column per tip in the same order; the diagonal is 0, unknown pairs are empty."""
    cell = lambda row, col, d: distances.select(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"), F.col(d).cast("double").alias("value"))
    tip = F.col("tip").cast("string")
    own = tips.select(tip.alias("row"), tip.alias("col"), F.lit(0.0).alias("value"))
    write_wide(cell(a, b, value).unionByName(cell(b, a, value)).unionByName(own), tips.select(tip.alias("row")), tips.select(tip.alias("col")), path, "tip")
