"""Pairwise alignments: gap splitting, mismatches, windows and identical runs.

A *part* is a gap-free stretch of one alignment block. It carries its mismatch
offsets as a sparse array, so everything after the first scan works on mismatches
and lengths, not on bases. Parts of a pair lie one after the other in (block_no,
start) order with one marker position between neighbours; a marker counts as one
mismatch and one position.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cladeframe.functions.batches import small_batches
from cladeframe.functions.scan import prefix_scan

PAIR = ["strain1", "strain2"]
_GAPS = re.compile("-{2,}")
_RUNS = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()))
_PARTS = T.ArrayType(T.StructType().add("start", T.LongType()).add("seq1", T.StringType()).add("seq2", T.StringType()))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


@F.pandas_udf(_RUNS)
def _gap_runs(seq1: pd.Series, seq2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [{"start": m.start(), "end": m.end()} for text in pair for m in _GAPS.finditer(text)]
            for pair in zip(seq1, seq2)
        ]
    )


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of a batch in one array, and how many each text has; bytes where all are ASCII."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    if not (raw & 128).any():
        return raw, np.diff(ends)
    return _codes(raw.tobytes().decode()), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _texts(codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Texts of the given sizes that follow each other in ``codes``."""
    ends = np.r_[0, np.cumsum(sizes)]
    if codes.dtype == np.uint8:
        raw = codes.tobytes()
    else:
        raw = codes.tobytes().decode("utf-32-le").encode()
        ends = np.r_[0, np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64))][ends]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())


def as_lists(counts: np.ndarray, **columns) -> pa.Array:
    """Lists of ``counts`` structs each, whose fields follow each other in ``columns``."""
    fields = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.StructArray.from_arrays(fields, names=list(columns)))


def _gap_free_row(a: str, b: str) -> list[dict]:
    runs = sorted([m.span() for m in _GAPS.finditer(a)] + [m.span() for m in _GAPS.finditer(b)])
    parts, at = [], 0
    for lo, hi in [*runs, (len(a), len(a))]:
        if lo > at:
            parts.append({"start": at, "seq1": a[at:lo], "seq2": b[at:lo]})
        at = max(at, hi)
    return parts


@F.arrow_udf(_PARTS)
def _gap_free(seq1: pa.Array, seq2: pa.Array) -> pa.Array:
    """All texts of a batch at once; texts that are not equally long go row by row."""
    row_type = pa.list_(pa.struct([("start", pa.int64()), ("seq1", pa.string()), ("seq2", pa.string())]))
    if seq1.null_count or seq2.null_count or not len(seq1):
        return pa.array([_gap_free_row(a, b) for a, b in zip(seq1.to_pylist(), seq2.to_pylist())], row_type)
    (one, size), (two, other) = _letters(seq1), _letters(seq2)
    if (size != other).any():
        return pa.array([_gap_free_row(a, b) for a, b in zip(seq1.to_pylist(), seq2.to_pylist())], row_type)
    begin = np.cumsum(size) - size
    inside = np.ones(len(one) + 1, bool)  # whether a place and the one before it are of one row
    inside[begin], inside[-1] = False, False
    gap = np.zeros(len(one), bool)
    for codes in (one, two):
        dash = codes == ord("-")
        both = dash[1:] & dash[:-1] & inside[1:-1]
        gap[1:] |= both
        gap[:-1] |= both
    kept = ~gap
    joined = kept[1:] & kept[:-1] & inside[1:-1]
    first, last = kept.copy(), kept.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    start = np.flatnonzero(first)
    long = np.flatnonzero(last) + 1 - start
    row = np.searchsorted(begin, start, side="right") - 1
    return as_lists(np.bincount(row, minlength=len(size)), start=start - begin[row], seq1=_texts(one[kept], long), seq2=_texts(two[kept], long))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def mismatch_offsets(seq1: pa.Array, seq2: pa.Array) -> pa.Array:
    """Sorted 0-based offsets where two equally long texts differ."""
    if not seq1.null_count and not seq2.null_count and len(seq1):
        (one, size), (two, other) = _letters(seq1), _letters(seq2)
        if (size == other).all():
            ends = np.cumsum(size)
            at = np.flatnonzero(one != two)
            counts = np.diff(np.r_[0, np.searchsorted(at, ends)])
            offsets = at - np.repeat(ends - size, counts)
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(offsets.astype(np.int32)))
    rows = [np.flatnonzero(_codes(a) != _codes(b)).astype(np.int32) for a, b in zip(seq1.to_pylist(), seq2.to_pylist())]
    return pa.array(rows, pa.list_(pa.int32()))


def gap_runs(blocks: DataFrame) -> DataFrame:
    """Runs of two or more gaps in either sequence, as intervals inside the block."""
    small_batches(blocks.sparkSession)
    return blocks.select(*PAIR, "block_no", F.inline(_gap_runs("seq1", "seq2")))


@F.pandas_udf(_RUNS)
def _complement(removed: pd.Series, size: pd.Series, times: pd.Series) -> pd.Series:
    """Stretches of 0 … size outside the removed intervals, which are sorted by start.

    Of a key that stands ``times`` over, the first stretch comes as often squared, as it does from ``complement_intervals``.
    """
    out = []
    for cuts, n, m in zip(removed, size, times):
        ivs = np.array([(c["start"], c["end"]) for c in cuts], np.int64).reshape(-1, 2)
        lo, hi = ivs[:, 0].clip(0), np.minimum(ivs[:, 1], n)
        lo, hi = lo[lo < hi], hi[lo < hi]
        reach = np.maximum.accumulate(np.r_[0, hi])
        out.append([{"start": int(a), "end": int(b)} for i, (a, b) in enumerate(zip(reach, np.r_[lo, n])) if a < b for _ in range(m * m if a == 0 else m)])
    return pd.Series(out)


def split_by_removed_intervals(blocks: DataFrame, removed: DataFrame) -> DataFrame:
    """Sub-blocks left after taking intervals (strain1, strain2, block_no, start, end) out; empty ones go.

    A block's intervals lie inside its own text, so they come to its one row as an array: they are shuffled once and so
    is each text.
    """
    small_batches(blocks.sparkSession)
    keys = [*PAIR, "block_no"]
    none = F.lit(None).cast("long")
    spans = blocks.select(*keys, none.alias("start"), none.alias("end"), F.lit(1).alias("rows"))
    cuts = removed.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(0).alias("rows"))
    each = cuts.unionByName(spans).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("rows") == 0, F.struct("start", "end")))).alias("cuts"), F.sum("rows").alias("times")
    )
    stretches = _complement("cuts", F.length("seq1").cast("long"), "times")
    kept = blocks.join(each, keys).select(*keys, "seq1", "seq2", F.inline(stretches))
    length = F.col("end") - F.col("start")
    first, size = (F.col("start") + 1).cast("int"), length.cast("int")
    return kept.select(
        *keys, "start", F.substring(F.col("seq1"), first, size).alias("seq1"), F.substring(F.col("seq2"), first, size).alias("seq2"),
        length.alias("length"),
    )


def split_at_gaps(blocks: DataFrame, min_block: int = 0) -> DataFrame:
    """Gap-free parts of every block in one pass over the rows, without a shuffle."""
    small_batches(blocks.sparkSession)
    parts = blocks.select(*PAIR, "block_no", F.inline(_gap_free("seq1", "seq2")))
    return parts.withColumn("length", F.length("seq1").cast("long")).filter(F.col("length") > min_block)


def with_mismatches(parts: DataFrame) -> DataFrame:
    """Replace the two texts by the sparse mismatch offsets."""
    small_batches(parts.sparkSession)
    return parts.select(*PAIR, "block_no", "start", "length", mismatch_offsets("seq1", "seq2").alias("mism"))


def place_parts(parts: DataFrame) -> DataFrame:
    """Add ``offset``, the position of a part in its pair's concatenation (markers included)."""
    return prefix_scan(
        parts, PAIR, ["block_no", "start"], F.floor(F.col("block_no") / 1024),
        {"offset": ("sum", F.col("length") + 1)},
    )


def pair_divergence(parts: DataFrame, count_joins: bool = True) -> DataFrame:
    """Aligned length, mismatches and divergence per pair.

    ``count_joins`` adds one mismatch and one position per join of two parts.
    """
    joins = (F.count(F.lit(1)) - 1) if count_joins else F.lit(0)
    n = F.sum(F.size("mism")) + joins
    size = F.sum("length") + joins
    return parts.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_parts"), size.alias("aligned_length"), n.alias("mismatches"),
        (n / size).alias("divergence"),
    )


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and how many each has; a null list has none."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def _bins(placed: DataFrame, width: int) -> DataFrame:
    """Mismatch counts per pair and position bin; markers sit just before every later part.

    A part's mismatches are counted on its own row, so as many rows as it touches bins are shuffled.
    """
    @F.arrow_udf("array<struct<bin:bigint,n:bigint>>")
    def own(offset: pa.Array, mism: pa.Array) -> pa.Array:
        offset = offset.to_numpy(zero_copy_only=False).astype(np.int64)
        at, counts = flat_lists(mism)
        marked = (offset > 0) & mism.is_valid().to_numpy(zero_copy_only=False)
        at = np.insert(at, (np.cumsum(counts) - counts)[marked], -1)
        row = np.repeat(np.arange(len(offset)), counts + marked)
        bin_ = (at + offset[row]) // width
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])][:len(row)])
        return as_lists(np.bincount(row[new], minlength=len(offset)), bin=bin_[new], n=np.diff(np.r_[new, len(row)]))

    small_batches(placed.sparkSession)
    return placed.select(*PAIR, F.inline(own(F.col("offset").cast("long"), "mism"))).groupBy(*PAIR, "bin").agg(F.sum("n").alias("n"))


def extra_windows(length: Column, window: int, step: int) -> Column:
    """Windows after the first one: the grid runs 0, W, W+step, … and ends with a tail."""
    return F.greatest(F.ceil((length - 2 * window) / step), F.lit(0)).cast("long")


def window_start(no: Column, window: int, step: int) -> Column:
    return F.when(no == 0, F.lit(0).cast("long")).otherwise(window + step * (no - 1))


def sliding_window_divergence(placed: DataFrame, totals: DataFrame, window: int = 500, step: int = 50) -> DataFrame:
    """Mismatches and divergence of every window of a pair, zeros included.

    The first window starts at 0, the next at W, then every ``step``; the last runs to
    the end. Mismatches are binned by gcd(W, step) before they meet their windows.
    """
    g = math.gcd(window, step)
    sized = totals.select(*PAIR, "aligned_length", extra_windows(F.col("aligned_length"), window, step).alias("last_no"))
    windows = sized.select(*PAIR, "aligned_length", "last_no", F.explode(F.sequence(F.lit(0).cast("long"), "last_no")).alias("window_no"))
    at = F.col("bin") * g
    hi = F.floor((at - window) / step) + 1
    lo = F.greatest(F.floor((at - 2 * window) / step) + 2, F.lit(1))
    first = F.when((at < window) | (F.col("last_no") == 0), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    lo, hi = F.least(lo, F.col("last_no")), F.least(hi, F.col("last_no"))
    later = F.when((at >= window) & (F.col("last_no") > 0) & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    hits = _bins(placed, g).join(sized, PAIR).select(*PAIR, F.explode(F.concat(first, later)).alias("window_no"), "n")
    counts = hits.groupBy(*PAIR, "window_no").agg(F.sum("n").alias("n"))
    start = window_start(F.col("window_no"), window, step)
    size = F.when(F.col("window_no") == F.col("last_no"), F.col("aligned_length") - start).otherwise(window)
    return windows.join(counts, [*PAIR, "window_no"], "left").select(
        *PAIR, "window_no", start.alias("start"), size.cast("long").alias("length"),
        F.coalesce("n", F.lit(0)).alias("mismatches"), (F.coalesce("n", F.lit(0)) / size).alias("divergence"),
    )


def identical_run_lengths(parts: DataFrame) -> DataFrame:
    """Histogram (strain1, strain2, run, n) of identical stretches between mismatches, both ends included.

    Joins count as mismatches, so a run never leaves its part and is found row by row.
    """
    left = F.concat(F.array(F.lit(-1).cast("int")), F.col("mism"))
    right = F.concat(F.col("mism"), F.array(F.col("length").cast("int")))
    runs = F.zip_with(left, right, lambda a, b: (b - a - 1).cast("long"))
    return parts.select(*PAIR, F.explode(runs).alias("run")).groupBy(*PAIR, "run").agg(F.count(F.lit(1)).alias("n"))
