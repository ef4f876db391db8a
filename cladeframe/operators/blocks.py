"""Multi-genome alignment blocks: complete blocks, column filters, core genome.

Rows are (label, isolate, seq). Column work cuts every row into slices of a fixed
number of columns, so one task sees one slice of one block: roster x slice letters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cladeframe.functions.scan import prefix_scan

SLICE = 4096


def complete_blocks(rows: DataFrame, roster: DataFrame, order: str = "row_no") -> DataFrame:
    """Blocks holding every isolate of the roster; of a repeated isolate the last row counts."""
    last = rows.join(roster.select("isolate").distinct(), "isolate", "left_semi").groupBy("label", "isolate").agg(
        F.max_by("seq", order).alias("seq")
    )
    total = roster.agg(F.count_distinct("isolate")).scalar()
    full = last.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == total).select("label")
    return last.join(full, "label", "left_semi")


def _slices(rows: DataFrame) -> DataFrame:
    n = F.ceil(F.length("seq") / SLICE).cast("int")
    return rows.filter(F.length("seq") > 0).select(
        "label", "isolate", F.explode(F.sequence(F.lit(0), n - 1)).alias("slice_no"), "seq"
    ).select(
        "label", "isolate", "slice_no",
        F.substring(F.col("seq"), F.col("slice_no") * SLICE + 1, F.lit(SLICE)).alias("piece"),
    )


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in pdf["piece"]])


def _keep_columns(pdf: pd.DataFrame, letters: np.ndarray, keep: np.ndarray, snps: int) -> pd.DataFrame:
    kept = np.ascontiguousarray(letters[:, keep])
    return pd.DataFrame(
        {
            "label": pdf["label"].to_numpy(), "isolate": pdf["isolate"].to_numpy(),
            "slice_no": pdf["slice_no"].to_numpy(), "piece": [r.tobytes().decode("utf-32-le") for r in kept],
            "snps": snps,
        }
    )


def _filter_columns(rows: DataFrame, mode: str, count_n: bool = True) -> DataFrame:
    def informative(pdf):
        letters = _matrix(pdf)
        real = (letters != ord("-")) & (letters != ord("N"))
        return _keep_columns(pdf, letters, real.sum(axis=0) > 1, 0)

    def gapless(pdf):
        letters = _matrix(pdf)
        keep = (letters != ord("-")).all(axis=0)
        core = letters[:, keep]
        if count_n:
            snps = (core != core[:1]).any(axis=0)
        else:
            known = core != ord("N")
            low = np.where(known, core, np.uint32(0xFFFFFFFF)).min(axis=0, initial=0xFFFFFFFF)
            snps = np.where(known, core, 0).max(axis=0, initial=0) > low
        return _keep_columns(pdf, letters, keep, int(snps.sum()))

    t = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return _slices(rows).groupBy("label", "slice_no").applyInPandas(
        informative if mode == "informative" else gapless,
        f"label {t['label']}, isolate {t['isolate']}, slice_no int, piece string, snps int",
    )


def _reassemble(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("label", "isolate").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice_no", "piece"))), lambda s: s["piece"]), "").alias("seq")
    )


def drop_uninformative_columns(rows: DataFrame) -> DataFrame:
    """Take out columns with at most one real base (neither gap nor N). Rows of a block are equally long."""
    return _reassemble(_filter_columns(rows, "informative"))


def core_columns_and_snps(
    rows: DataFrame, reference: str, min_length: int = 1, min_share: float = 0.0, count_n: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Gap-free columns of blocks that pass the length and gapless-share cuts.

    Returns (per label: raw_len, degap_len, gapless_share, snp_count) and the core
    sequences (label, isolate, seq). Both cuts are made on the reference isolate, before
    and after the gap columns go.
    """
    is_ref = F.col("isolate") == reference
    bare = F.length(F.regexp_replace("seq", "-", ""))
    first = rows.filter(is_ref).select("label", F.length("seq").alias("raw_len"), bare.alias("bare")).filter(
        (F.col("bare") >= min_length) & (F.try_divide(F.col("bare"), F.col("raw_len")) >= min_share)
    )
    pieces = _filter_columns(rows.join(first, "label", "left_semi"), "core", count_n)
    per = pieces.filter(is_ref).groupBy("label").agg(
        F.sum(F.length("piece")).alias("degap_len"), F.sum("snps").alias("snp_count")
    )
    table = per.join(first, "label").withColumn("gapless_share", F.col("degap_len") / F.col("raw_len")).filter(
        (F.col("degap_len") >= min_length) & (F.col("gapless_share") >= min_share)
    ).select("label", "raw_len", "degap_len", "gapless_share", "snp_count")
    return table, _reassemble(pieces.join(table, "label", "left_semi"))


def block_locations(table: DataFrame, starts: DataFrame, bucket_width: int = 1 << 20) -> DataFrame:
    """Place of every core block in the concatenation, in reference order: (label, start, loc_start, loc_end)."""
    used = table.select("label", "degap_len").join(starts, "label")
    placed = prefix_scan(used, [], ["start", "label"], F.floor(F.col("start") / bucket_width), {"loc_start": ("sum", "degap_len")})
    return placed.select("label", "start", "loc_start", (F.col("loc_start") + F.col("degap_len")).alias("loc_end"))


def core_genome_concat(core: DataFrame, locations: DataFrame) -> DataFrame:
    """One row per (isolate, block) with its place; read by ``loc_start`` it is the isolate's core sequence."""
    return core.join(locations, "label").select("isolate", "label", "start", "loc_start", "loc_end", "seq")
