"""Helpers that several text operators share: Arrow batches, ordered buckets, seeds, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cladeframe.functions.batches import bounded_batches  # noqa: F401
from cladeframe.functions.lineage import cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def quantile_cuts(df: DataFrame, value: Column, slices: int) -> tuple[list[int], int | None]:
    """At most ``slices`` - 1 values of an integer column that cut its rows evenly, and its maximum.

    Only these few numbers reach the driver.
    """
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    got = df.agg(F.percentile_approx(value, shares, F.lit(max(10_000, 20 * slices))).alias("q"), F.max(value).alias("top")).first()
    return sorted({int(v) for v in got["q"] or [] if v != got["top"]}), got["top"]


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``value``: a binary search inside one expression."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: at + F.when(F.coalesce(F.get(array, at + step - 1) < value, F.lit(False)), step).otherwise(F.lit(0)),
    )


_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers evenly (SplitMix64)."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, np.uint64) + _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def seed_of(*parts: int) -> int:
    """One 64-bit seed from several integers."""
    return int(reduce(lambda a, b: mix64(a ^ np.uint64(b & 0xFFFFFFFFFFFFFFFF)), parts, np.uint64(0x243F6A8885A308D3)))


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of 0 … n-1.

    Four Feistel rounds on the next even number of bits; values outside walk on until they fall inside.
    """
    if n <= 1:
        return np.zeros_like(np.asarray(index, np.int64))
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [mix64(np.uint64(seed) ^ mix64(np.uint64(r))) for r in range(4)]

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mix64(right ^ key) & mask)
        return (left << half) | right

    out = rounds(np.asarray(index, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = rounds(out[outside])
    return out.astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots, the smallest nodes of their components.

    Rounds of the small-star / large-star scheme: each node hands its smallest neighbour to the others, so
    paths shorten geometrically. A round is a grouping, never a gathered component, and its edges are written
    to the shared folder; it ends when no edge changes.
    """
    current = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.unionByName(low.filter("m < a").select("a", F.col("m").alias("b"))).distinct())
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(small_low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        if after.count() == current.count() and after.exceptAll(current).isEmpty():
            return after.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        current = after
